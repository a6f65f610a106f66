"""Signed graphs: edges from neighbours, energies, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.criteria import vote
from pointweave.operators.knn import neighbours
from pointweave.operators.transform import normalized
from pointweave.shared import looked_up


def neighbour_edges(near: DataFrame, criterion: str, radius: float) -> DataFrame:
    """hi, lo, d2, weight: an edge for each pair of neighbours, whichever of the two names the other. Weights are symmetric, so the first counts."""
    own = near.select(F.greatest("a_id", "b_id").alias("hi"), F.least("a_id", "b_id").alias("lo"), "d2", vote(criterion, "a", "b", radius).alias("weight"))
    return own.groupBy("hi", "lo").agg(F.min("d2").alias("d2"), F.min("weight").alias("weight"))


def edges_global(cloud: DataFrame, k: int, radius: float, criterion: str = "hoppe") -> DataFrame:
    return neighbour_edges(neighbours(normalized(cloud), k, radius), criterion, radius)


def segment_edges(near: DataFrame, segments: DataFrame, criterion: str, radius: float) -> DataFrame:
    """hi, lo, weight between segments (columns id, segment, flip): the sum of all votes between their points.

    Both criteria are linear in either normal, so the votes of the points as they came are only multiplied by the flips.
    """
    sides = {s: segments.select(F.col("id").alias(f"{s}_id"), F.col("segment").alias(f"{s}_segment"), F.col("flip").alias(f"{s}_flip")) for s in "ab"}
    own = near.select("a_id", "b_id", vote(criterion, "a", "b", radius).alias("vote")).join(sides["a"], "a_id").join(sides["b"], "b_id").where("a_segment != b_segment")
    hi, lo = F.greatest("a_segment", "b_segment"), F.least("a_segment", "b_segment")
    return own.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.sum(F.col("vote") * F.col("a_flip") * F.col("b_flip")).alias("weight"))


def segment_votes(near: DataFrame, segments: DataFrame, criterion: str, radius: float) -> DataFrame:
    """src, segment, positive and negative sum of votes and least d2, for each point and each segment among its neighbours."""
    own = segments.select(F.col("id").alias("b_id"), "segment")
    v = near.select("a_id", "b_id", "d2", vote(criterion, "a", "b", radius).alias("vote")).join(own, "b_id")
    return v.groupBy(F.col("a_id").alias("src"), "segment").agg(F.sum(F.greatest("vote", F.lit(0.0))).alias("pos"), F.sum(F.least("vote", F.lit(0.0))).alias("neg"), F.min("d2").alias("min_d2"))


def energy(edges: DataFrame) -> DataFrame:
    """Sum of the negative weights' sizes, and the number of edges."""
    return edges.agg(F.coalesce(F.sum(-F.least("weight", F.lit(0.0))), F.lit(0.0)).alias("energy"), F.count("*").alias("edges"))


def labelled(edges: DataFrame, solution: DataFrame, total: int | None = None) -> DataFrame:
    """edges (total of them; else they are counted) with the signs of both ends as sign_hi and sign_lo. A node with very many edges is met by broadcast."""
    total = edges.count() if total is None else total
    for end in ("hi", "lo"):
        edges = looked_up(edges, solution.select(F.col("node").alias(end), F.col("sign").alias(f"sign_{end}")), end, total)
    return edges


def resigned(edges: DataFrame, solution: DataFrame) -> DataFrame:
    """Edges with their weight as the solution turns it; edges of weight 0 say nothing and go."""
    return labelled(edges.where("weight != 0"), solution).withColumn("weight", F.col("weight") * F.col("sign_hi") * F.col("sign_lo")).drop("sign_hi", "sign_lo")


def model_energy(edges: DataFrame, solution: DataFrame) -> DataFrame:
    """Cost of a labelling: the weights' sizes of edges whose ends are not as their weights ask."""
    return energy(resigned(edges, solution))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.count_if(F.col("weight") < 0).alias("negative"), F.count_if(F.col("weight") == 0).alias("zero"))


def unorientable(edges: DataFrame, solution: DataFrame) -> DataFrame:
    """Edges whose ends' signs are not as their weight asks (0 asks for equal signs), and all edges."""
    asked = F.when(F.col("weight") < 0, -1).otherwise(1)
    return labelled(edges, solution).agg(F.count_if(F.col("sign_hi") * F.col("sign_lo") != asked).alias("unorientable"), F.count("*").alias("edges"))
