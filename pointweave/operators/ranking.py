"""Global row numbers without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.shared import stored


def sorted_ranges(df: DataFrame, order: list) -> DataFrame:
    """df in ranges of the order, with column `range` numbering them; stored, so the ranges stay what they are."""
    return stored(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, order: list, name: str, keep_range: bool = False) -> DataFrame:
    """Adds column `name`: 1, 2, ... in the given order, which must be total. A row's number is its place in its range after the sizes of the ranges before."""
    rows = sorted_ranges(df, order)
    sizes = rows.groupBy("range").agg(F.count("*").alias("rows"))
    # a window over one row for each range
    before = sizes.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    out = rows.withColumn(name, place.cast("long")).join(F.broadcast(before), "range").withColumn(name, F.col(name) + F.col("before")).drop("before")
    return out if keep_range else out.drop("range")
