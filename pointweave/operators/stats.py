"""Global aggregates of clouds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.ranking import ranked
from pointweave.operators.transform import dbl
from pointweave.schema import XYZ
from pointweave.shared import looked_up, stored_with


def bbox(cloud: DataFrame) -> DataFrame:
    return cloud.agg(*(f(dbl(c)).alias(f"{n}_{c[1]}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))))


def centroid(cloud: DataFrame) -> DataFrame:
    return cloud.agg(*(F.avg(dbl(c)).alias(f"c{c[1]}") for c in XYZ))


PAIRS = [("px", "px"), ("px", "py"), ("px", "pz"), ("py", "py"), ("py", "pz"), ("pz", "pz")]


def covariance(cloud: DataFrame) -> DataFrame:
    """Population covariance of the positions, in one pass."""
    return cloud.agg(*(F.covar_pop(dbl(a), dbl(b)).alias(f"c{a[1]}{b[1]}") for a, b in PAIRS))


def pca_rotation(row) -> list[list[float]]:
    """Rotation whose rows are the covariance's axes, longest first. Each axis has its largest component positive; the last is the cross product of the others."""
    a = np.zeros((3, 3))
    for (p, q), v in zip(PAIRS, row, strict=True):
        i, j = XYZ.index(p), XYZ.index(q)
        a[i, j] = a[j, i] = v if v is not None else 0.0
    _, vectors = np.linalg.eigh(a)
    first, second = vectors[:, 2], vectors[:, 1]
    first, second = (v * (1 if v[np.argmax(np.abs(v))] > 0 else -1) for v in (first, second))
    return [first.tolist(), second.tolist(), np.cross(first, second).tolist()]


def slice_size(cloud: DataFrame, width: float) -> int:
    """Most points in a closed slice along x. A slice opens at its first point and closes at the first one that is width or more
    beyond; the last stays open and doesn't count, unless no slice closes: then all points do.

    Each point's next opening point is found by one sort of the points and of where their slices end. Then the steps are doubled:
    a row's step becomes that step and the one after it, and rows that no step leads to any more drop out, until the first
    point's row has reached the end.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    rows = cloud.select(dbl("px").alias("px"), "id").where("px is not null")
    points = ranked(rows, [F.col("px"), F.col("id")], "place")
    end = F.col("px") + F.lit(float(width))
    # x + width may round to x: then the next place opens a slice
    marks = points.select(F.col("px").alias("at"), F.lit(1).alias("kind"), "place").union(points.select(end.alias("at"), F.lit(0).alias("kind"), "place"))
    met = ranked(marks, [F.col("at"), F.col("kind"), F.col("place")], "mark").where("kind = 0")
    # ends are in the points' own order, so before the mark of the end of `place` stand `place - 1` ends; the others are points
    following = F.greatest(F.col("mark") - F.col("place") + 1, F.col("place") + 1)
    n = points.count()
    steps = met.select("place", F.when(following <= n, following).alias("next")).withColumn("most", F.col("next") - F.col("place"))
    while n:
        steps, seen = stored_with(steps, "steps", rows=F.count("*"), first=F.max(F.when(F.col("place") == 1, F.coalesce("next", F.lit(0)))), most=F.max(F.when(F.col("place") == 1, F.col("most"))))
        if not seen["first"]:
            return seen["most"] or n
        later = steps.select(F.col("place").alias("next"), F.col("next").alias("then"), F.col("most").alias("later"))
        double = looked_up(steps, later, "next", seen["rows"], "left").select("place", F.col("then").alias("next"), F.greatest("most", "later").alias("most"))
        reached = steps.where("next is not null").select(F.col("next").alias("place")).union(cloud.sparkSession.range(1, 2).toDF("place")).distinct()
        steps = double.join(reached, "place", "left_semi")
    return 0
