"""Writers: PLY and XYZ text, binary records, a folder for each component."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from pointweave.operators.ranking import ranked
from pointweave.schema import COLOR, NORMAL, XYZ
from pointweave.sources.clouds import RECORD

#: Fixed values of the format: the properties of the vertex element.
HEADER_PROPERTIES = [("float", "x"), ("float", "y"), ("float", "z"), ("float", "nx"), ("float", "ny"), ("float", "nz"), ("uchar", "red"), ("uchar", "green"), ("uchar", "blue")]


@F.pandas_udf(StringType())
def six_digits(x: pd.Series) -> pd.Series:
    return pd.Series(["%.6g" % v for v in x.tolist()], dtype="object")


def number(name: str) -> Column:
    """Up to six significant digits of the exact value (exact halves to the even digit, as C's %.6g), without trailing zeros: plain between 1e-4 and 1e6, else with an exponent of two digits or more."""
    return F.when(F.col(name).isNotNull(), six_digits(F.col(name).cast("double")))


def rows_text(cloud: DataFrame) -> Column:
    columns = [c for c in (*XYZ, *NORMAL, *COLOR) if c in cloud.columns]
    return F.concat_ws(" ", *(F.col(c).cast("int").cast("string") if c in COLOR else number(c) for c in columns))


def ply_lines(cloud: DataFrame) -> DataFrame:
    """place (from 0, headers first) and value of each line of the cloud's ASCII PLY file, points in order of id."""
    spark = cloud.sparkSession
    kept = [p for p, c in zip(HEADER_PROPERTIES, [*XYZ, *NORMAL, *COLOR], strict=True) if c in cloud.columns]
    n = cloud.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property {kind} {name}" for kind, name in kept), "end_header"]
    body = ranked(cloud.select("id", rows_text(cloud).alias("value")), [F.col("id"), F.col("value")], "place").select((F.col("place") + len(head) - 1).alias("place"), "value")
    lines = spark.range(1).select(F.posexplode(F.array(*map(F.lit, head))).alias("place", "value")).select(F.col("place").cast("long").alias("place"), "value")
    return lines.union(body)


def write_ply(cloud: DataFrame, path: str) -> None:
    """Part files in order, of which the first starts with the header; together they are one ASCII PLY file."""
    ply_lines(cloud).repartitionByRange("place").sortWithinPartitions("place").select("value").write.text(path)


def write_xyz(cloud: DataFrame, path: str) -> None:
    cloud.repartitionByRange("id").sortWithinPartitions("id").select(rows_text(cloud).alias("value")).write.text(path)


class BinarySink(DataSource):
    """Appends each task's records to a part file of its own under the option path; a failed attempt's file is removed."""

    @classmethod
    def name(cls) -> str:
        return "pointweave_records"

    def schema(self) -> str:
        return "place int, record binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BinaryWriter(self.options["path"])


@dataclass
class Part(WriterCommitMessage):
    name: str


class BinaryWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Part:
        context = TaskContext.get()
        name = f"{self.path}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        files, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), "")
        place = name.partition("://")[2] or name
        files.create_dir(place.rpartition("/")[0])
        with files.open_output_stream(place) as out:
            for row in iterator:
                out.write(bytes(row.record))
        return Part(name)

    def commit(self, messages: list[Part]) -> None:
        for part in messages:
            files, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), "")
            place = part.name.partition("://")[2] or part.name
            head, _, last = place.rpartition("/")
            files.move(place, f"{head}/{last.removeprefix('.').rpartition('-')[0]}")

    def abort(self, messages: list[Part]) -> None:
        for part in filter(None, messages):
            files, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), "")
            files.delete_file(part.name.partition("://")[2] or part.name)


def write_bin(cloud: DataFrame, path: str) -> None:
    """Part files of fixed-length records in order of id, which read_bin reads back. path is in a store that pyarrow can write (a shared folder, hdfs, s3)."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            r = np.zeros(len(part), dtype=RECORD)
            for field, names in (("p", XYZ), ("n", NORMAL), ("c", COLOR)):
                for k, c in enumerate(names):
                    if c in part:
                        r[field][:, k] = part[c]
            yield pd.DataFrame({"place": 0, "record": [r.tobytes()]})

    cloud.sparkSession.dataSource.register(BinarySink)
    records = cloud.repartitionByRange("id").sortWithinPartitions("id").mapInPandas(encode, "place int, record binary")
    records.write.format(BinarySink.name()).mode("append").option("path", path).save()


def write_components(points: DataFrame, path: str) -> None:
    """Parquet folders comp_rank=0, 1, ...; points have column comp_rank."""
    points.write.partitionBy("comp_rank").parquet(path)
