"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.ranking import ranked
from pointweave.operators.transform import dbl
from pointweave.schema import XYZ
from pointweave.shared import looked_up, stored_with


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the least node it reaches) of every node in edges (a, b), by alternating large-star and small-star.

    Large-star ties a node's greater neighbours to its least neighbour (or itself), small-star its smaller neighbours and
    itself; both only send minima, aggregated before the shuffle, and a node with very many neighbours gets its minimum
    by broadcast, so that a star's centre is no task of its own. The loop ends when the edges no longer change. Null ends,
    loops and repeated edges are ignored; no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b").distinct()
    size = {"n": F.count("*"), "hash": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges, seen = stored_with(edges, "edges", **size)
    for _ in range(most_rounds):
        if not seen["n"]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = looked_up(both, least, "a", 2 * seen["n"], count="n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = looked_up(large, least, "a", seen["n"], count="n").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, now = stored_with(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges", **size)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def of_points(cloud: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component of every point; a point without edges is a component of its own."""
    found = connected(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
    return cloud.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def boxes(points: DataFrame) -> DataFrame:
    """component, n and bounding box, from points with column component."""
    return points.groupBy("component").agg(F.count("*").alias("n"), *(f(dbl(c)).alias(f"{n}_{c[1]}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))))


def large_enough(comps: DataFrame, min_extent: float | None, strict: bool = False) -> DataFrame:
    """Adds kept: every extent of the box is at least (strict: over) min_extent; None keeps all."""
    if min_extent is None:
        return comps.withColumn("kept", F.lit(True))
    least = F.least(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"))
    return comps.withColumn("kept", (least > min_extent) if strict else (least >= min_extent))


def by_size(comps: DataFrame) -> DataFrame:
    """Adds comp_rank among the kept components: 0 for the one with most points, ties by component."""
    return ranked(comps.where("kept"), [F.desc("n"), F.asc("component")], "comp_rank").withColumn("comp_rank", (F.col("comp_rank") - 1).cast("int"))
