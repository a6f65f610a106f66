"""Radius-bounded nearest neighbours as an equi-join on grid cells.

Cells are as wide as the search radius. A point asks only the cells that its ball reaches, and of points at one place only
the k + 1 least ids can be among anyone's k nearest, so others are dropped before the join. In dense clouds the search
starts with a small radius; who has k neighbours within it is done, the rest go on with twice the radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions.criteria import squared_distance
from pointweave.schema import NORMAL, XYZ
from pointweave.shared import stored

CARRIED = ["id", *XYZ, *NORMAL]
#: Points in a point's own cell, in mean over the points, from which on a smaller radius is tried first.
CROWDED = 64
MOST_HALVINGS = 12


def check(k: int, radius: float) -> None:
    if k < 1 or radius <= 0:
        raise ValueError("k must be at least 1 and the radius positive")


def cell(name: str, width: float) -> Column:
    return F.floor(F.col(name).cast("double") / F.lit(width))


def reached(side: str, axis: str, radius: float) -> Column:
    """The cells along an axis that a ball around the point reaches: its own, and a neighbour if that is nearer than the radius."""
    x = F.col(f"{side}_{axis}").cast("double")
    return F.sequence(F.floor((x - F.lit(radius)) / F.lit(radius)), F.floor((x + F.lit(radius)) / F.lit(radius)))


def sided(cloud: DataFrame, side: str, by: tuple[str, ...] = ()) -> DataFrame:
    return cloud.select(*by, *(F.col(c).alias(f"{side}_{c}") for c in CARRIED if c in cloud.columns))


def candidate_pairs(points: DataFrame, cloud: DataFrame, radius: float, causal: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a (of points), b (of cloud) of different ids, and the same in the columns by, with d2 < radius squared; causal: b stands before a by (px, id)."""
    asks = sided(points, "a", by)
    for axis in XYZ:
        asks = asks.withColumn(f"cell_{axis}", F.explode(reached("a", axis, radius)))
    # of the cells in the ball's box only those that the ball itself reaches
    gap = F.lit(0.0)
    for axis in XYZ:
        x, low = F.col(f"a_{axis}").cast("double"), F.col(f"cell_{axis}") * F.lit(radius)
        short = F.greatest(low - x, x - low - F.lit(radius), F.lit(0.0))
        gap = gap + short * short
    asks = asks.where(gap <= F.lit(radius * radius * (1 + 1e-9)))
    answers = sided(cloud, "b", by).withColumns({f"cell_{axis}": F.floor(F.col(f"b_{axis}").cast("double") / F.lit(radius)) for axis in XYZ})
    met = [*by, *(f"cell_{axis}" for axis in XYZ)]
    pairs = asks.join(answers, met).drop(*met).withColumn("d2", squared_distance("a", "b"))
    apart = F.col("a_id") != F.col("b_id")
    if causal:
        apart = (F.col("b_px") < F.col("a_px")) | ((F.col("b_px") == F.col("a_px")) & (F.col("b_id") < F.col("a_id")))
    return pairs.where(apart & (F.col("d2") < F.lit(radius * radius)))


def usable(cloud: DataFrame) -> DataFrame:
    """Points with an id and a finite position; others have no neighbours."""
    finite = F.col("id").isNotNull()
    for axis in XYZ:
        finite = finite & (F.abs(F.col(axis).cast("double")) < F.lit(float("inf")))
    return cloud.where(finite)


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy("d2", "b_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(cloud: DataFrame, k: int, radius: float, causal: bool = False, asks: DataFrame | None = None) -> DataFrame:
    """The k nearest points within the radius of each point, ties by id: a_* and b_* columns (id, position, normal), d2, rank.

    causal: only points that stand before it in x order (then id). asks: those of the cloud's points whose neighbours are wanted, if not all. Points without id or with a null, NaN or infinite
    position take no part. Ids are taken to be unique; a repeated id counts as one point per row among the answers.
    """
    check(k, radius)
    carried = [c for c in CARRIED if c in cloud.columns]
    points = usable(cloud).select(carried)
    return searched(points if asks is None else usable(asks).select(carried), points, k, radius, causal)


def searched(asks: DataFrame, points: DataFrame, k: int, radius: float, causal: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest of points to each that asks, among those that are the same in the columns by."""
    place = F.row_number().over(Window.partitionBy(*by, *XYZ).orderBy("id"))
    answers = points.withColumn("_place", place).where(F.col("_place") <= k + 1).drop("_place")
    crowd = points.groupBy(*by, *(cell(a, radius).alias(a) for a in XYZ)).count().agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("c")).first().c or 0
    radii, r = [radius], radius
    while crowd > CROWDED and len(radii) <= MOST_HALVINGS:
        r, crowd = r / 2, crowd / 4  # by 4 rather than 8: clouds are mostly surfaces
        radii.insert(0, r)
    found = None
    for r in radii:
        near = nearest(candidate_pairs(asks, answers, r, causal, by), k)
        if r == radius:
            return near if found is None else found.unionByName(near)
        near = stored(near, "near")
        done = near.where(F.col("rank") == k).select(F.col("a_id").alias("id"))
        whole = near.join(done.withColumnRenamed("id", "a_id"), "a_id", "left_semi")
        found = whole if found is None else found.unionByName(whole)
        asks = stored(asks.join(done, "id", "left_anti"), "unfinished")
    raise AssertionError


def as_knn(near: DataFrame) -> DataFrame:
    return near.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "d2", F.col("rank").cast("int").alias("rank"))


def knn_global(cloud: DataFrame, k: int, radius: float) -> DataFrame:
    return as_knn(neighbours(cloud, k, radius))


def knn_causal(cloud: DataFrame, k: int, radius: float) -> DataFrame:
    return as_knn(neighbours(cloud, k, radius, causal=True))


def cell_neighbours(cloud: DataFrame, k: int, radius: float, key: Column) -> DataFrame:
    """As neighbours, but only among points with the same key (such as slice and Morton cell; null is none), and without normals."""
    check(k, radius)
    points = usable(cloud).select(*CARRIED[:4], key.alias("_key"))
    return searched(points, points, k, radius, False, ("_key",))


def knn_cell(cloud: DataFrame, k: int, radius: float, key: Column) -> DataFrame:
    return as_knn(cell_neighbours(cloud, k, radius, key))


def candidate_counts(cloud: DataFrame, radius: float) -> DataFrame:
    """Points and pairs of cells that touch, from the cells' sizes alone: what a search without the ball's test would compare."""
    cells = usable(cloud).groupBy(*(cell(a, radius).alias(a) for a in XYZ)).agg(F.count("*").alias("n"))
    around = cells.withColumn("own", F.array(*XYZ))
    for axis in XYZ:
        around = around.withColumn(axis, F.explode(F.sequence(F.col(axis) - 1, F.col(axis) + 1)))
    met = around.withColumnRenamed("n", "m").join(cells, XYZ)
    points = F.coalesce(F.sum(F.when(F.col("own") == F.array(*XYZ), F.col("n"))), F.lit(0))
    return met.agg(points.alias("points"), (F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)) - points).alias("candidates"))
