"""A maximum spanning forest that is kept in a folder and grows by new edges.

New edges meet the kept trees by their ends' components and signs, so that rounds run over the trees that they touch, not over the
nodes. Edges that close a cycle can push out a lesser edge of the forest; only groups of trees in which one is better than the least
edge of the group's forest are solved again, from their forest's edges and those that close cycles. Edges that were ever left out stay
out, as a cycle's least edge does, so the forest is the one that all edges at once would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators.forest import asked, better, joined, spanning_forest, usable
from pointweave.shared import looked_up, stored, stored_with

FOREST, SOLUTION = "hi long, lo long, weight double", "node long, component long, sign int"
ENDS = ["hi", "lo", "weight"]


def grown(forest: DataFrame, solution: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forest (hi, lo, weight) and solution (node, component, sign) after edges (hi, lo, weight) have come to those given.

    The same as spanning_forest() of all edges that ever came, if those between the same two nodes have the same weight; an edge of
    the forest that comes again changes nothing. Odd edges take no part, as there.
    """
    n_nodes, n_forest = solution.count(), forest.count()
    new, seen = stored_with(usable(edges), "new", n=F.count("*"))
    if not seen["n"]:
        return forest, solution
    for end in ("hi", "lo"):
        known = solution.select(F.col("node").alias(end), F.col("component").alias(f"u_{end}"), F.col("sign").alias(f"s_{end}"))
        new = looked_up(new, known, end, seen["n"], "left")
    new = stored(new.select(*ENDS, *(F.col(f"u_{e}").isNull().alias(f"new_{e}") for e in ("hi", "lo")), F.coalesce("u_hi", "hi").alias("u"), F.coalesce("u_lo", "lo").alias("v"), (asked() * F.coalesce("s_hi", F.lit(1)) * F.coalesce("s_lo", F.lit(1))).cast("int").alias("s")), "met")
    taken, tops = joined(new.where("u != v"))
    taken, tops = stored(taken, "taken"), stored(tops.select(F.col("node").alias("tree"), F.col("component").alias("top"), F.col("sign").alias("turn")), "tops")

    moved = looked_up(solution, tops.withColumnRenamed("tree", "component"), "component", n_nodes, "left")
    moved = moved.select("node", F.coalesce("top", "component").alias("component"), (F.col("sign") * F.coalesce("turn", F.lit(1))).cast("int").alias("sign"))
    fresh = new.where("new_hi").select(F.col("hi").alias("tree")).union(new.where("new_lo").select(F.col("lo").alias("tree"))).distinct()
    solution, nodes = stored_with(moved.union(fresh.join(tops, "tree").select("tree", "top", "turn")), "solution", n=F.count("*"))

    closing = new.join(taken, ["hi", "lo"], "left_anti").join(forest, ["hi", "lo"], "left_anti")
    closing = looked_up(closing.select(*ENDS, F.col("u").alias("tree")), tops.select("tree", "top"), "tree", seen["n"], "left")
    closing, closes = stored_with(closing.select(*ENDS, F.coalesce("top", "tree").alias("component")), "closing", n=F.count("*"))
    whole = forest.select(ENDS).union(taken.select(ENDS))
    if not closes["n"]:
        return stored(whole, "forest"), solution
    total = n_forest + seen["n"]
    whole = stored(looked_up(whole, solution.select(F.col("node").alias("hi"), "component"), "hi", total), "whole")
    best = closing.groupBy("component").agg(F.max(better()).alias("best"))
    least = whole.groupBy("component").agg(F.min(better()).alias("least"))
    again = stored(best.join(least, "component").where("best > least").select("component", "least"), "again")
    marked = stored(looked_up(whole, again, "component", total, "left"), "marked")
    kept = marked.where("least is null").select(ENDS)
    better_ones = looked_up(closing, again, "component", closes["n"]).where(better() > F.col("least"))
    rest = looked_up(solution, again, "component", nodes["n"], "left").where("least is null").select("node", "component", "sign")
    part, signs = spanning_forest(marked.where("least is not null").select(ENDS).union(better_ones.select(ENDS)))
    return stored(kept.union(part.select(ENDS)), "forest"), stored(rest.union(signs.select("node", "component", "sign")), "solution")


def versions(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """Numbers of the versions in the folder that were written to their end, and the next free number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    every = sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-") and n.removeprefix("version-").isdigit())
    done = lambda k, table: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-{k}/{table}/_SUCCESS"))
    return [k for k in every if done(k, "forest") and done(k, "solution")], (every[-1] + 1 if every else 0)


def saved(forest: DataFrame, solution: DataFrame, path: str) -> int:
    """Write a new version into the folder, beside those that are there; returns its number. One that is cut short doesn't count."""
    k = versions(forest.sparkSession, path)[1]
    forest.select(ENDS).write.parquet(f"{path}/version-{k}/forest")
    solution.select("node", "component", "sign").write.parquet(f"{path}/version-{k}/solution")
    return k


def loaded(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Forest and solution of a version (None: the last one); an empty forest where there is no version yet."""
    done = versions(spark, path)[0]
    if version is not None and version not in done:
        raise ValueError(f"there is no whole version {version} in {path}")
    if not done:
        return spark.createDataFrame([], FOREST), spark.createDataFrame([], SOLUTION)
    base = f"{path}/version-{done[-1] if version is None else version}"
    return spark.read.schema(FOREST).parquet(f"{base}/forest"), spark.read.schema(SOLUTION).parquet(f"{base}/solution")


def grow(edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Let the forest in the folder grow by edges: a new version of it, read back. To do it again with the same edges gives the same forest."""
    spark = edges.sparkSession
    version = saved(*grown(*loaded(spark, path), edges), path)
    return loaded(spark, path, version)
