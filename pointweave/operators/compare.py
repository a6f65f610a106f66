"""Comparison of two clouds' normals at the same positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.operators.ranking import ranked
from pointweave.operators.transform import dbl
from pointweave.schema import NORMAL, XYZ
from pointweave.shared import looked_up

#: Up to so many points at one position are numbered in one task.
MOST_AT_ONE = 10_000


def numbered(cloud: DataFrame) -> DataFrame:
    """Adds nth: the place of a point, by id, among those at its position."""
    most, n = cloud.groupBy(*XYZ).count().agg(F.max("count"), F.sum("count")).first()
    if (most or 0) <= MOST_AT_ONE:
        return cloud.withColumn("nth", F.row_number().over(Window.partitionBy(*XYZ).orderBy("id")).cast("long") - 1)
    rows = ranked(cloud.withColumn("at", F.struct(*XYZ)), [F.col("at"), F.col("id")], "place")
    first = rows.groupBy("at").agg(F.min("place").alias("first"))
    return looked_up(rows, first, "at", n).withColumn("nth", F.col("place") - F.col("first")).drop("at", "place", "first")


def compare_normals(first: DataFrame, second: DataFrame) -> DataFrame:
    """correct (dot product over 0), wrong (else, or NaN), and points of either cloud without a partner. Points at one position pair off in order of id."""

    def placed(cloud: DataFrame, side: str) -> DataFrame:
        return numbered(cloud.select("id", *XYZ, *NORMAL)).select(*XYZ, "nth", *(dbl(c).alias(f"{side}_{c}") for c in NORMAL), F.lit(True).alias(f"in_{side}"))

    both = placed(first, "a").join(placed(second, "b"), [*XYZ, "nth"], "full_outer")
    dot = sum((F.col(f"a_{c}") * F.col(f"b_{c}") for c in NORMAL[1:]), F.col("a_nx") * F.col("b_nx"))
    met = F.col("in_a") & F.col("in_b")
    right = met & (dot > 0) & ~F.isnan(dot)
    return both.agg(F.count_if(right).alias("correct"), F.count_if(met & ~F.coalesce(right, F.lit(False))).alias("wrong"), F.count_if(F.col("in_b").isNull()).alias("skipped1"), F.count_if(F.col("in_a").isNull()).alias("skipped2"))
