"""Whole jobs: preparing a cloud, orienting it at once or by a sweep, and what follows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators import components, forest, graph, refine, roof, segment, stats, transform, trust
from pointweave.operators.knn import neighbours
from pointweave.operators.ranking import ranked
from pointweave.shared import looked_up, stored, stored_with


@dataclass
class Prepared:
    """A realigned cloud in x order, and how to undo the move: position = rotation * (original - centroid)."""

    cloud: DataFrame
    centroid: tuple[float, float, float]
    rotation: list[list[float]]


def prepare(cloud: DataFrame, realign: bool = True) -> Prepared:
    """Centre the cloud, turn its longest axis to x, and sort by x (then id); column ord counts from 1."""
    row = cloud.agg(*(F.avg(transform.dbl(c)) for c in stats.XYZ), *(F.covar_pop(transform.dbl(a), transform.dbl(b)) for a, b in stats.PAIRS)).first()
    centre = tuple(float(x or 0.0) for x in row[:3])
    rotation = stats.pca_rotation(row[3:]) if realign else [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    if not realign:
        centre = (0.0, 0.0, 0.0)
    turned = transform.transformed(transform.moved(cloud, tuple(-x for x in centre)), rotation)
    return Prepared(ranked(turned, [F.col("px"), F.col("id")], "ord"), centre, rotation)


def forest_only(edges: DataFrame) -> DataFrame:
    """The maximum spanning forest's signs, passed on in every component."""
    return forest.spanning_forest(edges)[1]


def forest_refined(edges: DataFrame) -> DataFrame:
    """The forest's signs, then single flips that lower the energy until none does."""
    return refine.refined(edges, forest_only(edges))


def forest_roof(edges: DataFrame) -> DataFrame:
    """As forest_refined, then turns that roof duality finds while a part of the nodes is held, then single flips again."""
    return roof.improved(edges, forest_refined(edges))


def forest_trusted(edges: DataFrame) -> DataFrame:
    """As forest_refined, then steps of a trust region, then single flips again."""
    return refine.refined(edges, trust.trusted(edges, forest_refined(edges)))


def first_tree_only(edges: DataFrame) -> DataFrame:
    """The forest's signs in the component of the least node of all; elsewhere all signs stay as they are."""
    solution = stored(forest_only(edges), "solution")
    first = solution.agg(F.min("component")).first()[0]
    return solution.select("node", "component", F.when(F.col("component") == F.lit(first), F.col("sign")).otherwise(F.lit(1)).alias("sign"))


def components_only(edges: DataFrame) -> DataFrame:
    """All signs as they are; only components."""
    return components.connected(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b"))).withColumn("sign", F.lit(1))


#: Solvers: from edges (hi, lo, weight) to node, component, sign.
SOLVERS: dict[str, Callable[[DataFrame], DataFrame]] = {"forest": forest_only, "first tree": first_tree_only, "refined": forest_refined, "roof": forest_roof, "trust region": forest_trusted, "components": components_only}


def solve(edges: DataFrame, solver: str = "refined") -> DataFrame:
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}; there are {', '.join(SOLVERS)}")
    return SOLVERS[solver](edges)


def finished(points: DataFrame, min_extent: float | None, strict: bool) -> DataFrame:
    """Points (column component) of components that are large enough, with comp_rank: 0 for the largest."""
    points, seen = stored_with(points, "points", rows=F.count("*"))
    comps = components.by_size(components.large_enough(components.boxes(points), min_extent, strict))
    # nearly all points may be in one component
    ranks = stored(comps.select("component", "comp_rank", F.col("n").alias("_rows")), "ranks")
    return looked_up(points, ranks, "component", seen["rows"], count="_rows").drop("_rows")


def orient_global(cloud: DataFrame, k: int = 6, radius: float = 1.0, criterion: str = "hoppe", min_extent: float | None = None, solver: str = "refined") -> DataFrame:
    """The cloud with normals of length 1 and consistent signs, white, with component and comp_rank.

    In each component the least id's normal keeps its sign. Components with an extent not over min_extent go (None: all stay).
    """
    cloud = transform.normalized(cloud)
    edges = stored(graph.neighbour_edges(neighbours(cloud, k, radius), criterion, radius), "edges")
    points = transform.signed(cloud, solve(edges, solver))
    white = F.lit(255).cast("smallint")
    return finished(points.withColumns({"red": white, "green": white, "blue": white}), min_extent, strict=True)


def orient_stream(cloud: DataFrame, k: int = 6, radius: float = 1.0, criterion: str = "hoppe", theta_s: float = 0.0, theta_acc: float = 0.5, min_extent: float | None = None, solver: str = "refined", slab_points: int = segment.SLAB_POINTS) -> DataFrame:
    """As orient_global, by a sweep along x: points gather in segments, and only the segments' graph is solved. Adds segment; colours tell the segments."""
    cloud = transform.normalized(cloud)
    near = stored(neighbours(cloud, k, radius, causal=True), "near")
    return from_segments(cloud, near, k, radius, criterion, theta_s, theta_acc, min_extent, solver, slab_points)


def from_segments(cloud: DataFrame, near: DataFrame, k: int, radius: float, criterion: str, theta_s: float, theta_acc: float, min_extent: float | None, solver: str, slab_points: int) -> DataFrame:
    segments = stored(segment.segmented(cloud, near, criterion, radius, theta_s, theta_acc, slab_points), "segments")
    edges = stored(graph.segment_edges(near, segments, criterion, radius), "edges")
    solution = solve(edges, solver).select(F.col("node").alias("segment"), "component", "sign")
    both = segments.join(solution, "segment", "left").select("id", "segment", (F.col("flip") * F.coalesce("sign", F.lit(1))).alias("sign"), F.coalesce("component", "segment").alias("component"))
    points = cloud.drop("red", "green", "blue").join(both, "id").withColumns({c: F.col(c) * F.col("sign") for c in transform.NORMAL}).drop("sign")
    return finished(points.withColumns(transform.segment_color(F.col("segment"))), min_extent, strict=False)


def accuracy(oriented: DataFrame, truth: DataFrame) -> DataFrame:
    """Points of each component whose normal agrees with the truth's (same id), and all."""
    own = truth.select("id", *(transform.dbl(c).alias(f"t_{c}") for c in transform.NORMAL))
    dot = F.col("nx") * F.col("t_nx") + F.col("ny") * F.col("t_ny") + F.col("nz") * F.col("t_nz")
    return oriented.join(own, "id").groupBy("component").agg(F.count_if(dot > 0).alias("agree"), F.count("*").alias("n"))
