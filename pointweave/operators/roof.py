"""Roof duality: labels that every best labelling shares, by a minimum cut of the doubled graph, and improvement of a labelling by it.

Each node stands in the doubled graph twice, for its sign as it is and for the opposite one. An edge that asks for equal signs ties
equal kinds of its ends, one that asks for opposite signs ties different kinds. Nodes whose sign is given are the source (as they are)
and the sink (turned). A node of which one kind is on the sink's side of the cut nearest to the sink has, in every best labelling, the other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.operators.flow import SINK, sink_side
from pointweave.operators.graph import resigned
from pointweave.operators.ranking import ranked
from pointweave.operators.refine import flipped, refined
from pointweave.shared import forget, stored, stored_with

#: Of so many parts of the nodes a round of improvement leaves FREE parts open, by hash.
PARTS, FREE = 4, 2


def persistent(edges: DataFrame, fixed: DataFrame) -> DataFrame:
    """node and turn (1 or -1) of nodes whose sign is the same in every best labelling of edges (hi, lo, weight) in which the nodes of fixed keep theirs.

    Nodes of which best labellings differ, or of which the relaxation cannot tell, are missing; fixed ones have turn 1. Edges of weight 0, loops, and such with null ends or
    weight take no part.
    """
    edges = edges.where("weight != 0 and not isnan(weight) and hi != lo").select("hi", "lo", F.col("weight").cast("double").alias("weight"))
    nodes = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct()
    known = fixed.select("node", F.lit(True).alias("given")).distinct()
    nodes = stored(ranked(nodes.join(known, "node", "left"), [F.col("node")], "place"), "nodes")
    ends = {e: nodes.select(F.col("node").alias(e), F.col("place").alias(f"{e}_place"), F.col("given").alias(f"{e}_given")) for e in ("hi", "lo")}
    met = stored(edges.join(ends["hi"], "hi").join(ends["lo"], "lo").select("hi_place", "hi_given", "lo_place", "lo_given", "weight"), "met")

    def kind(end: str, turned: int) -> Column:
        """The doubled node; null is the source."""
        terminal = F.lit(SINK).cast("long") if turned else F.lit(None).cast("long")
        return F.when(F.col(f"{end}_given"), terminal).otherwise(2 * F.col(f"{end}_place") + turned)

    other = (F.col("weight") < 0).cast("int")
    pairs = None
    for turned in (0, 1):
        lo = F.when(other == 1, kind("lo", 1 - turned)).otherwise(kind("lo", turned))
        part = met.select(kind("hi", turned).alias("u"), lo.alias("v"), F.abs("weight").alias("r"))
        pairs = part if pairs is None else pairs.union(part)
    both = stored(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "r")), "doubled")
    arcs = both.where(F.col("u").isNotNull() & (F.col("u") != SINK) & F.col("v").isNotNull())
    excess = both.where(F.col("u").isNull() & (F.col("v") != SINK)).select(F.col("v").alias("u"), F.col("r").alias("e"))
    lost = sink_side(arcs, excess)  # a kind on the sink's side is the one that is not taken
    turn = lost.select(F.floor(F.col("u") / 2).alias("place"), F.when(F.col("u") % 2 == 1, 1).otherwise(-1).alias("turn"))
    return nodes.join(turn, "place").select("node", "turn").union(nodes.where("given").select("node", F.lit(1).alias("turn")))


def improved(edges: DataFrame, solution: DataFrame, rounds: int = 4, seed: int = 0) -> DataFrame:
    """solution (node, component, sign) with the turns that roof duality finds while some nodes are held as they are, then single flips.

    A round holds a part of the nodes, drawn by hash, and the least node of each component; of the others those turn that turn in every best labelling of
    the rest. Whatever the open ones do, that never costs, so the energy falls or stays in every round.
    """
    edges = stored(edges.where("weight != 0").select("hi", "lo", "weight"), "edges")
    solution = stored(solution, "solution")
    for k in range(rounds):
        held = solution.where((F.col("node") == F.col("component")) | (F.pmod(F.xxhash64("node", F.lit(seed), F.lit(k)), F.lit(PARTS)) >= FREE))
        turns, seen = stored_with(persistent(resigned(edges, solution), held.select("node")).where("turn < 0"), "turns", n=F.count("*"))
        if seen["n"]:
            before, solution = solution, stored(flipped(solution, turns), "solution")
            forget(before)
    return refined(edges, solution)
