"""Energy-reducing refinement of a labelling: rounds of single flips.

A node's gain is what its flip saves: the sizes of its edges' weights that are not as asked, less those of the others.
In a round those nodes flip that gain, and gain more than any neighbour that gains (ties: the lesser node), so that no two
neighbours flip together and each flip saves its gain. The least node of each component never flips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.graph import labelled
from pointweave.shared import forget, looked_up, stored, stored_with

LEAST_GAIN = 1e-9


def flipped(solution: DataFrame, turns: DataFrame) -> DataFrame:
    """solution with the signs of turns (node, turn) multiplied by their turn."""
    return solution.join(turns, "node", "left").select("node", "component", (F.col("sign") * F.coalesce("turn", F.lit(1))).cast("int").alias("sign"))


def refined(edges: DataFrame, solution: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """solution (node, component, sign) with flips until none gains; each round lowers the energy. Raises if most_rounds do not do."""
    edges, of_edges = stored_with(edges.where("weight != 0").select("hi", "lo", "weight"), "edges", n=F.count("*"))
    solution = stored(solution, "solution")
    for _ in range(most_rounds):
        turned = labelled(edges, solution, of_edges["n"]).withColumn("w", F.col("weight") * F.col("sign_hi") * F.col("sign_lo"))
        gains = turned.select(F.col("hi").alias("node"), "w").union(turned.select(F.col("lo").alias("node"), "w")).groupBy("node").agg((-F.sum("w")).alias("gain"))
        gains = gains.join(solution.where("node != component").select("node"), "node", "left_semi").where(F.col("gain") > LEAST_GAIN)
        gains, seen = stored_with(gains, "gains", n=F.count("*"))
        if not seen["n"]:
            break
        hi = gains.select(F.col("node").alias("hi"), F.col("gain").alias("gain_hi"))
        lo = gains.select(F.col("node").alias("lo"), F.col("gain").alias("gain_lo"))
        rivals = looked_up(looked_up(edges, hi, "hi", of_edges["n"]), lo, "lo", of_edges["n"])
        lost = rivals.select(F.when(F.col("gain_hi") > F.col("gain_lo"), F.col("lo")).otherwise(F.col("hi")).alias("node")).distinct()
        flips = gains.join(lost, "node", "left_anti").select("node", F.lit(-1).alias("turn"))
        before, solution = solution, stored(flipped(solution, flips), "solution")
        forget(before, gains)
    else:
        raise RuntimeError(f"nodes still gain after {most_rounds} rounds")
    return solution
