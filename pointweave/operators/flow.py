"""Minimum cuts of large graphs by rounds of joins: excess runs down the levels of a breadth-first search from the sink.

A phase labels every node by its distance to the sink in the residual graph, then lets excess go from the farthest level to the next
one, level by level. So an arc carries flow at most once a phase and residuals are settled once at its end. What finds its way barred
waits for the next phase's labels; the phases end when no node with excess can reach the sink any more. Parts of the graph that are not tied to each
other are cut side by side: small ones in tasks of bounded size, by the same phases.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.operators.components import connected
from pointweave.shared import forget, looked_up, stored, stored_with

#: The sink among the nodes, which are not negative, the source in tasks; and the least amount of flow that counts.
SINK, SOURCE, LEAST = -1, -2, 1e-12
MOST_PHASES, MOST_LEVELS = 1_000, 100_000
#: Arcs of a part that a task cuts by itself (some 100 bytes each, and as much for the rows), and about those that it is given of smaller parts.
SMALL, BUNDLE = 2_000_000, 200_000


def levels(arcs: DataFrame, active: DataFrame | None, n: int) -> tuple[DataFrame, int]:
    """u and d (arcs to the sink over residuals) of nodes that reach it, and the greatest d; of all of them, or so many levels that the n nodes of active are among them, if they are."""
    open_ = arcs.where(F.col("r") > LEAST)
    found, parts, all_ = open_.where(F.col("v") == SINK).select("u").distinct(), [], None
    for d in range(1, MOST_LEVELS):
        rows = found.withColumn("d", F.lit(d))
        rows = rows.withColumn("a", F.lit(0)) if active is None else rows.join(active.select("u", F.lit(1).alias("a")), "u", "left")
        rows, seen = stored_with(rows, "level", n=F.count("*"), a=F.count("a"))
        n -= seen["a"] if active is not None else 0
        if not seen["n"]:
            break
        parts.append(rows.select("u", "d"))
        all_ = parts[0] if len(parts) == 1 else all_.union(parts[-1])
        if active is not None and not n:
            break
        further = open_.join(parts[-1].select(F.col("u").alias("v")), "v").select("u").distinct()
        found = further.join(all_.select("u"), "u", "left_anti")
    return (all_ if parts else rows.select("u", "d")), len(parts)


def pushed(leveled: DataFrame, excess: DataFrame, level: int) -> DataFrame:
    """u, v, p: what nodes of a level give to the next one; arcs in order of v take as much as they can until nothing is left."""
    down = leveled.where(F.col("du") == level).select("u", "v", "r").join(excess.groupBy("u").agg(F.sum("e").alias("e")), "u")
    before = F.coalesce(F.sum("r").over(Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return down.withColumn("p", F.least("r", F.col("e") - before)).where(F.col("p") > LEAST).select("u", "v", "p")


def arrived(push: DataFrame) -> DataFrame:
    return push.where(F.col("v") != SINK).select(F.col("v").alias("u"), F.col("p").alias("e"))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, count of them, one range after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def cut_here(u: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """sink_side() of a graph in memory: arcs u, v (SINK, or a node) and r; what the source gives to a node has SOURCE as v. Each pair stands once.

    Phases as by joins, a level at a time as arrays: the arcs of a level's nodes that go down are taken in turns, each node's first arc, then each one's second."""
    nodes = np.unique(np.concatenate([u, v[v >= 0]]))
    n, at = len(nodes), np.searchsorted(nodes, u)
    excess, to_sink = (np.bincount(at[v == end], weights=r[v == end], minlength=n) for end in (SOURCE, SINK))
    inner = v >= 0
    tail, head, own = at[inner], np.searchsorted(nodes, v[inner]), r[inner]
    key = np.unique(np.concatenate([tail * n + head, head * n + tail]))  # both directions, in order of tail and head
    rest = np.bincount(np.searchsorted(key, tail * n + head), weights=own, minlength=len(key))
    tail, head = np.divmod(key, max(n, 1))
    back = np.searchsorted(key, head * n + tail)
    first = np.searchsorted(tail, np.arange(n + 1))
    while True:
        level = np.zeros(n, dtype=np.int64)
        last = np.flatnonzero(to_sink > LEAST)
        depth = 0
        while len(last):
            depth += 1
            level[last] = depth
            arcs = spread(first[last], first[last + 1] - first[last])
            last = np.unique(head[arcs[(rest[back[arcs]] > LEAST) & (level[head[arcs]] == 0)]])
        if not ((excess > LEAST) & (level > 0)).any():
            return nodes[level > 0]
        down = np.flatnonzero((level[tail] == level[head] + 1) & (level[head] > 0) & (rest > LEAST))
        turn = np.arange(len(down)) - np.searchsorted(tail[down], tail[down])
        step = (depth - level[tail[down]]) * (turn.max(initial=0) + 1) + turn
        order = np.argsort(step, kind="stable")
        for arcs in np.split(down[order], np.flatnonzero(np.diff(step[order])) + 1):
            arcs = arcs[excess[tail[arcs]] > LEAST]
            given = np.minimum(rest[arcs], excess[tail[arcs]])
            rest[arcs] -= given
            rest[back[arcs]] += given
            excess[tail[arcs]] -= given
            np.add.at(excess, head[arcs], given)
        given = np.where(to_sink > LEAST, np.minimum(excess, to_sink), 0.0)
        excess, to_sink = excess - given, to_sink - given


def cut_in_tasks(rows: DataFrame, n: int) -> DataFrame:
    """u of sink_side() for parts of the graph that are small; rows: part, u, v (null for excess) and r, n of them."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"u": cut_here(own["u"].to_numpy(), own["v"].to_numpy(), own["r"].to_numpy())}, dtype="int64")

    bundle = F.pmod(F.xxhash64("part"), F.lit(max(1, -(-n // BUNDLE))))
    own = rows.select(bundle.alias("bundle"), "u", F.coalesce("v", F.lit(SOURCE).cast("long")).alias("v"), "r")
    return own.groupBy("bundle").applyInPandas(run, "u long")


def sink_side(arcs: DataFrame, excess: DataFrame) -> DataFrame:
    """u: the nodes that still reach the sink when all the flow there is has gone there, which is the sink's side of the minimum cut nearest to it.

    arcs: u, v (SINK, or a node) and r, both directions of a pair as rows of their own; excess: u and e, what the source gives to u. Rows of a pair
    or node that repeat are added up. Parts of over SMALL arcs are cut by rounds of joins.
    """
    arcs = stored(arcs.groupBy("u", "v").agg(F.sum("r").cast("double").alias("r")), "arcs")
    every = arcs.union(excess.groupBy("u").agg(F.sum("e").cast("double").alias("r")).select("u", F.lit(None).cast("long").alias("v"), "r"))
    every, seen = stored_with(every, "every", n=F.count("*"))
    if seen["n"] <= min(SMALL, BUNDLE):  # one task's work, whatever the parts are
        return cut_in_tasks(every.withColumn("part", F.lit(0).cast("long")), seen["n"])
    tied = connected(arcs.where(F.col("v") != SINK).select(F.col("u").alias("a"), F.col("v").alias("b")))
    rows, seen = stored_with(every.join(tied.withColumnRenamed("node", "u"), "u", "left").select("u", "v", "r", F.coalesce("component", "u").alias("part")), "rows", n=F.count("*"))
    sizes, most = stored_with(rows.groupBy("part").agg(F.count("*").alias("n")), "sizes", n=F.max("n"))
    if (most["n"] or 0) <= SMALL:
        return cut_in_tasks(rows, seen["n"])
    sized, of_sized = stored_with(looked_up(rows, sizes, "part", seen["n"], count="n"), "sized", small=F.count_if(F.col("n") <= SMALL))
    large = sized.where(F.col("n") > SMALL)
    far = cut_by_joins(large.where("v is not null").select("u", "v", "r"), large.where("v is null").select("u", F.col("r").alias("e")))
    return far.union(cut_in_tasks(sized.where(F.col("n") <= SMALL), of_sized["small"]))


def cut_by_joins(arcs: DataFrame, excess: DataFrame) -> DataFrame:
    """sink_side() of a graph of any size; no pair or node repeats."""
    spark = arcs.sparkSession
    arcs = stored(arcs, "arcs")
    excess, active = stored_with(excess.where(F.col("e") > LEAST), "excess", n=F.count("*"))
    for _ in range(MOST_PHASES):
        reach, depth = levels(arcs, excess, active["n"]) if active["n"] else levels(arcs, None, 0)
        if not active["n"]:
            return reach.select("u")
        sides = reach.select(F.col("u").alias("v"), F.col("d").alias("dv")).union(spark.createDataFrame([(SINK, 0)], "v long, dv int"))
        leveled = stored(arcs.where(F.col("r") > LEAST).join(reach.withColumnRenamed("d", "du"), "u").join(sides, "v").where("du = dv + 1").select("u", "v", "r", "du"), "leveled")
        own = stored(excess.join(reach, "u"), "own")  # who does not reach the sink never will, and goes
        pushes: list[DataFrame] = []
        for level in range(depth, 0, -1):
            given = own.where(F.col("d") == level).select("u", "e")
            if pushes:  # what comes to a level comes from the one above
                given = given.union(arrived(pushes[-1]))
            pushes.append(stored(pushed(leveled, given, level), "push"))
        left, change = own.select("u", "e"), arcs
        for push in pushes:
            left = left.union(arrived(push)).union(push.select("u", (-F.col("p")).alias("e")))
            change = change.union(push.select("u", "v", (-F.col("p")).alias("r"))).union(push.where(F.col("v") != SINK).select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("p").alias("r")))
        before = [arcs, excess, leveled, own, *pushes]
        arcs = stored(change.groupBy("u", "v").agg(F.sum("r").alias("r")), "arcs")
        excess, active = stored_with(left.groupBy("u").agg(F.sum("e").alias("e")).where(F.col("e") > LEAST), "excess", n=F.count("*"))
        forget(*before)
    raise RuntimeError(f"flow still finds its way after {MOST_PHASES} phases")
