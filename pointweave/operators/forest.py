"""Maximum spanning forests of signed graphs and the signs that they ask for.

In each round every tree takes its best edge to another tree; trees so joined become one by pointer jumping, with the
product of the signs along the way. The order by size of weight, then ends, is total, so the forest is unique. Of the edges
between two trees only the best goes on to the next round, and a node's tree is put together from the rounds' tables of
trees, each at most half as long as the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.shared import looked_up, stored, stored_with

MOST_ROUNDS = 60
EDGE = ["u", "v", "s", "hi", "lo", "weight"]


def better() -> Column:
    """The total order of edges, greatest best."""
    return F.struct(F.abs("weight"), -F.col("hi"), -F.col("lo"))


def times(*signs: str) -> Column:
    out = F.col(signs[0])
    for s in signs[1:]:
        out = out * F.col(s)
    return out.cast("int")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forest edges (hi, lo, weight) and solution (node, component, sign) of edges (hi, lo, weight).

    Signs keep every forest edge's wish (a negative weight asks for different signs, 0 for equal ones); the least node of
    each component, which names it, has sign 1. Edges with null ends or NaN or null weight, loops and repeated edges (of which the one
    with the larger weight counts) take no part.
    """
    return joined(usable(edges).select(F.col("hi").alias("u"), F.col("lo").alias("v"), asked().alias("s"), "hi", "lo", "weight"))


def usable(edges: DataFrame) -> DataFrame:
    """The edges that take part, each once."""
    own = edges.where("hi is not null and lo is not null and hi != lo and weight is not null and not isnan(weight)")
    return own.groupBy(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).agg(F.max("weight").cast("double").alias("weight"))


def asked() -> Column:
    return F.when(F.col("weight") < 0, -1).otherwise(1)


def joined(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As spanning_forest, of trees: edges with u and v, the trees of both ends, and s, the sign that u's root asks of v's root. Nodes of the solution are the trees."""
    open_, seen = stored_with(edges.select(EDGE), "open", n=F.count("*"))
    taken, trees = [], []
    for _ in range(MOST_ROUNDS):
        if not seen["n"]:
            break
        both = open_.union(open_.select(F.col("v").alias("u"), F.col("u").alias("v"), *EDGE[2:]))
        best = both.groupBy("u").agg(F.max_by(F.struct(*EDGE[1:]), better()).alias("e")).select("u", "e.*")
        best, of_best = stored_with(best, "best", n=F.count("*"))
        taken.append(best.select("hi", "lo", "weight").distinct())
        trees.append(rooted(best, of_best["n"]))
        root = trees[-1]
        met = open_
        for end in "uv":
            met = looked_up(met, root.select(F.col("tree").alias(end), F.col("root").alias(f"r{end}"), F.col("turn").alias(f"t{end}")), end, seen["n"])
        met = met.where("ru != rv").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v"), times("s", "tu", "tv").alias("s"), *EDGE[3:])
        left = met.groupBy("u", "v").agg(F.max_by(F.struct(*EDGE[2:]), better()).alias("e")).select("u", "v", "e.*")
        open_, seen = stored_with(left, "open", n=F.count("*"))
    else:
        raise RuntimeError("the forest did not settle")
    if not trees:
        return open_.select("hi", "lo", "weight"), open_.select(F.col("u").alias("node"), F.col("u").alias("component"), F.lit(1).alias("sign"))
    forest = taken[0]
    for part in taken[1:]:
        forest = forest.union(part)
    whole = composed(trees)
    least = whole.groupBy("root").agg(F.min_by(F.struct("tree", "turn"), "tree").alias("first"))
    named = looked_up(whole, least, "root", whole.count())
    solution = named.select(F.col("tree").alias("node"), F.col("first.tree").alias("component"), (F.col("turn") * F.col("first.turn")).cast("int").alias("sign"))
    return forest, solution


def composed(trees: list[DataFrame]) -> DataFrame:
    """tree, root and turn from the first round's trees (the nodes) to the last one's roots; a tree that found no edge in a round stays what it is."""
    out = trees[-1]
    for earlier in reversed(trees[:-1]):
        n = earlier.count()
        later = out.select(F.col("tree").alias("root"), F.col("root").alias("top"), F.col("turn").alias("more"))
        met = looked_up(earlier, later, "root", n, "left")
        out = met.select("tree", F.coalesce("top", "root").alias("root"), (F.col("turn") * F.coalesce("more", F.lit(1))).cast("int").alias("turn"))
    return stored(out, "trees")


def rooted(best: DataFrame, n: int) -> DataFrame:
    """tree, root and turn (the product of the signs on the way) of n trees, from the best edge (u to v with sign s) of each."""
    other = best.select(F.col("u").alias("v"), F.col("v").alias("back"))
    # two trees may take the same edge; the lesser is then the root
    own = (F.col("back") == F.col("u")) & (F.col("u") < F.col("v"))
    up = looked_up(best, other, "v", n, "left")
    up = up.select("u", F.when(own, F.col("u")).otherwise(F.col("v")).alias("p"), F.when(own, F.lit(1)).otherwise(F.col("s")).alias("s"))
    for _ in range(MOST_ROUNDS):
        for _ in range(2):
            further = up.select(F.col("u").alias("p"), F.col("p").alias("pp"), F.col("s").alias("ps"))
            up = looked_up(up.select("u", "p", "s"), further, "p", n).select("u", F.col("pp").alias("p"), times("s", "ps").alias("s"), (F.col("p") != F.col("pp")).alias("moved"))
        up, seen = stored_with(up, "up", moved=F.count_if("moved"))
        up = up.drop("moved")
        if not seen["moved"]:
            return up.select(F.col("u").alias("tree"), F.col("p").alias("root"), F.col("s").alias("turn"))
    raise RuntimeError("the trees' roots were not found")
