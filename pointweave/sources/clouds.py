"""Readers: ASCII PLY and XYZ files, folders of XYZ files, fixed-length binary records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from pointweave.operators.ranking import ranked
from pointweave.schema import COLOR, NORMAL, POINT, XYZ

RECORD = np.dtype([("p", "<f4", 3), ("n", "<f4", 3), ("c", "u1", 3), ("pad", "u1")])
SEGMENT_RECORD = np.dtype([*RECORD.descr, ("segment", "<i4")])
#: Records that a task reads, and that it decodes at once.
RECORDS_PER_TASK, RECORDS_PER_BATCH = 4_000_000, 100_000
#: Fixed value: records that a stream takes at a time.
RECORDS_PER_TRIGGER = 4_096
#: The columns of a PLY or XYZ row, in order.
ROW = [*XYZ, *NORMAL, *COLOR]


class FileReadError(IOError):
    def __init__(self, path: str):
        super().__init__(f'Cannot read file "{path}".')


def _lines(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """file, line (its text) and at (an increasing number) of every line."""
    try:
        text = spark.read.options(**options).text(paths)
    except AnalysisException as e:
        raise FileReadError(", ".join(paths)) from e
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.trim(F.regexp_replace("value", "[\t\r]", " ")).alias("line"))


def _rows(lines: DataFrame) -> DataFrame:
    """A point for every line that starts with a number; headers have none, and short rows leave the rest 0."""
    body = lines.where(F.col("line").rlike(r"^[-+]?(\d|\.\d|nan|inf)")).withColumn("v", F.split("line", r"\s+"))
    at = [F.get("v", F.lit(k)) for k in range(9)]
    out = [at[k].try_cast("float").alias(ROW[k]) for k in range(3)]
    out += [F.coalesce(at[k].try_cast("float"), F.lit(0.0).cast("float")).alias(ROW[k]) for k in range(3, 6)]
    out += [F.coalesce(at[k].try_cast("double").try_cast("smallint"), F.lit(0).cast("smallint")).alias(ROW[k]) for k in range(6, 9)]
    return body.select("file", "block", F.monotonically_increasing_id().alias("at"), *out)


def _numbered(rows: DataFrame) -> DataFrame:
    return ranked(rows, [F.col("file"), F.col("block"), F.col("at")], "id").select((F.col("id") - 1).alias("id"), *ROW)


def read_ply(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A cloud from ASCII PLY or XYZ files: rows of x y z [nx ny nz [red green blue]]. Header lines, of which there may be none, and blank lines are
    no points; missing normals and colours are 0. Ids count the rows in order of file and line."""
    return _numbered(_rows(_lines(spark, [path] if isinstance(path, str) else list(path))))


def read_xyz_dir(spark: SparkSession, folder: str) -> DataFrame:
    """All *.xyz files of a folder, without its subfolders."""
    return _numbered(_rows(_lines(spark, [folder], pathGlobFilter="*.xyz")))


@dataclass
class Records(InputPartition):
    """Records of one file, by their offset in it, and the number of the first of them in the cloud."""

    path: str
    offset: int
    records: int
    first: int


class RecordSource(DataSource):
    """Clouds in files of fixed-length records: option path is a file or a folder (names with a leading dot or underscore are no data)."""

    @classmethod
    def name(cls) -> str:
        return "pointweave_cloud"

    def schema(self) -> str:
        return POINT + (", segment int" if self.options.get("segments") == "true" else "")

    def made(self, kind: type) -> RecordReader:
        return kind(self.options["path"], self.options.get("segments") == "true", int(self.options.get("recordsPerTask", RECORDS_PER_TASK)), int(self.options.get("recordsPerBatch", RECORDS_PER_TRIGGER)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.made(RecordReader)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return self.made(RecordStream)


class RecordReader(DataSourceReader):
    def __init__(self, path: str, segments: bool, most: int, per_batch: int):
        self.path, self.segments, self.most, self.per_batch = path, segments, most, per_batch

    def files(self) -> fs.FileSystem:
        return fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()

    def sizes(self) -> list[tuple[str, int]]:
        """Files in order of their names, and their numbers of whole records; a file's last bytes short of a record are none."""
        size = (SEGMENT_RECORD if self.segments else RECORD).itemsize
        place = fs.FileSystem.from_uri(self.path)[1] if "://" in self.path else self.path
        found = self.files().get_file_info(place)
        if found.type == fs.FileType.NotFound:
            raise FileReadError(self.path)
        if found.type == fs.FileType.Directory:
            every = self.files().get_file_info(fs.FileSelector(place))
            every = sorted((f for f in every if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)
        else:
            every = [found]
        return [(file.path, file.size // size) for file in every]

    def ranges(self, start: int, end: int | None = None) -> list[Records]:
        """Ranges of whole records, file by file, of the records from start to end in the order of files."""
        size, out, first = (SEGMENT_RECORD if self.segments else RECORD).itemsize, [], 0
        for path, n in self.sizes():
            lo, hi = max(start - first, 0), n if end is None else min(end - first, n)
            out += [Records(path, k * size, min(self.most, hi - k), first + k) for k in range(lo, hi, self.most)]
            first += n
        return out

    def partitions(self) -> list[Records]:
        return self.ranges(0)

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        kind = SEGMENT_RECORD if self.segments else RECORD
        with self.files().open_input_file(partition.path) as file:
            file.seek(partition.offset)
            for at in range(0, partition.records, RECORDS_PER_BATCH):
                r = np.frombuffer(file.read(min(RECORDS_PER_BATCH, partition.records - at) * kind.itemsize), dtype=kind)
                out = [pa.array(np.arange(len(r)) + partition.first + at)]
                out += [pa.array(np.ascontiguousarray(r[field][:, k])) for field in "pn" for k in range(3)] + [pa.array(r["c"][:, k].astype("i2")) for k in range(3)]
                names = ["id", *ROW]
                if self.segments:
                    out, names = [*out, pa.array(np.ascontiguousarray(r["segment"]))], [*names, "segment"]
                yield pa.RecordBatch.from_arrays(out, names)


class RecordStream(RecordReader, DataSourceStreamReader):
    """Records as a stream: an offset is how many records have been read, and a batch takes recordsPerBatch more at most. Files may be added under names that come after the others'."""

    at: int | None = None

    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        # after a restart Spark plans or commits the last batch before it asks for more
        self.at = min((self.at or 0) + self.per_batch, max(self.at or 0, sum(n for _, n in self.sizes())))
        return {"records": self.at}

    def partitions(self, start: dict, end: dict) -> list[Records]:
        self.at = max(self.at or 0, end["records"])
        return self.ranges(start["records"], end["records"])

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["records"])


def read_bin_stream(spark: SparkSession, path: str, records_per_batch: int = 4096, segments: bool = False) -> DataFrame:
    """As read_bin, as a stream that takes so many records a batch, in order of files and records."""
    spark.dataSource.register(RecordSource)
    return spark.readStream.format(RecordSource.name()).option("path", path).option("segments", str(segments).lower()).option("recordsPerBatch", records_per_batch).load()


def read_bin(spark: SparkSession, path: str, segments: bool = False) -> DataFrame:
    """A cloud from fixed-length little-endian records: 6 floats, 3 colour bytes, a byte of padding (and an int segment). Ids count the records.

    Tasks read ranges of whole records; a record's id follows from the files' sizes, so nothing is read twice."""
    spark.dataSource.register(RecordSource)
    return spark.read.format(RecordSource.name()).option("path", path).option("segments", str(segments).lower()).load()
