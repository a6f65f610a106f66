"""Tables in the folder that driver and executors share, and joins that stand hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders of local applications that name none.
_OWN: dict[str, str] = {}
#: A key with fewer rows is never hot, and no key of a table with so few rows as fit any task is.
LEAST_HOT, FEW_ROWS = 256, 8_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder given to setCheckpointDir. Where neither is set, a local session gets a new folder; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="pointweave-")
        base = _OWN[app]
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            remove(table.sparkSession, folder)


def stored_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """As stored(), and aggregates over the rows, worked out as they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *(c.alias(k) for k, c in measures.items())), name)
    return out, seen.get


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner", count: str | None = None) -> DataFrame:
    """rows joined with table on the column key, which is unique in table; total: about the number of rows.

    Keys with many rows (a quarter of a task's share; so there are at most four times as many as tasks) meet their table rows
    by broadcast and are not dealt by key; the others are joined by a shuffle. Null keys find nothing. how: inner or left. count: table's column with each key's number of rows, if
    it has one; else they are counted.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(LEAST_HOT, total // (4 * tasks))
    if total <= FEW_ROWS:
        return rows.join(table, key, how)
    other = [c for c in table.columns if c != key]
    if count:
        hot = table.where((F.col(count) > most) & F.col(key).isNotNull())
    else:
        hot = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > most).select(key).join(table, key, how)
    few = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot"), *other))
    met = rows.join(few, key, "left")
    there = met.where("_hot").select(*rows.columns, *other)
    rest = met.where(F.col("_hot").isNull()).select(rows.columns)
    if how == "inner":
        return there.unionByName(rest.join(table, key).select(*rows.columns, *other))
    named = rest.where(F.col(key).isNotNull()).join(table, key, how).select(*rows.columns, *other)
    types = dict(table.dtypes)
    nulls = rest.where(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(types[c]).alias(c) for c in other))
    return there.unionByName(named).unionByName(nulls)
