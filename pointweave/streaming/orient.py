"""Orientation of a stream in two passes: the first writes segments and their edges batch by batch, the second turns the points by their segments' signs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators import transform
from pointweave.plans.orient import finished, solve
from pointweave.shared import shared_dir, stored
from pointweave.streaming.segments import EDGE, PLACE, POINT, Late, segments_of_stream

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
POINTS = "cloud string, id long, " + ", ".join(f"{c} double" for c in PLACE) + ", segment long, flip int, late boolean"
EDGES = "hi long, lo long, weight double"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state with lists and timers needs RocksDB's store; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])


def first_pass(base: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch's points and edges into folders of its own number, so that a batch that comes again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        names = lambda schema: [c.split()[0] for c in schema.split(", ")]
        batch.where(F.col("kind") == POINT).select(names(POINTS)).write.mode("overwrite").parquet(f"{base}/points/batch={number}")
        batch.where(F.col("kind") == EDGE).select(names(EDGES)).write.mode("overwrite").parquet(f"{base}/edges/batch={number}")
        batch.unpersist()

    return write


def run_segments(stream: DataFrame, name: str, k: int, radius: float, x_min: float, criterion: str = "hoppe", theta_s: float = 0.0, theta_acc: float = 0.5, by: str | None = None, late: str = "flag") -> tuple[str, Late]:
    """Drive the first pass over all that the stream has; returns its folder (points and edges by batch) and what was late. late: "flag", or "raise" if there are late points.

    Called again with the same name, it goes on where it ended."""
    if late not in ("flag", "raise"):
        raise ValueError("late must be flag or raise")
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}"
    found = segments_of_stream(transform.normalized(stream), k, radius, x_min, criterion, theta_s, theta_acc, by)
    found = found.observe("sweep", F.count_if("late").alias("late"), F.count_if(F.col("kind") == POINT).alias("points"), F.max("held").alias("held"))
    own = f"{name}-{uuid.uuid4().hex}"
    listener = Late(own)
    spark.streams.addListener(listener)
    try:
        with keyed_state(spark):
            query = found.writeStream.queryName(own).foreachBatch(first_pass(base)).option("checkpointLocation", f"{base}/checkpoint").start()
            try:
                query.processAllAvailable()
            finally:
                query.stop()
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        spark.streams.removeListener(listener)
    if late == "raise" and listener.late:
        raise ValueError(f"{listener.late} points came late: the stream is not in x order")
    return base, listener


def second_pass(spark: SparkSession, base: str, name: str, signs: DataFrame) -> DataFrame:
    """The first pass's points as a stream, joined with their segments' component and sign (a table): turned, coloured by segment, written."""
    points = spark.readStream.schema(POINTS).option("recursiveFileLookup", "true").parquet(f"{base}/points").where("not late").drop("late", "cloud")
    both = points.join(signs, "segment", "left")
    sign = F.col("flip") * F.coalesce("sign", F.lit(1))
    turned = both.withColumns({c: F.col(c) * sign for c in transform.NORMAL} | {"component": F.coalesce("component", "segment")}).drop("flip", "sign")
    turned = turned.withColumns(transform.segment_color(F.col("segment")))
    query = turned.writeStream.format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/{name}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(turned.schema).parquet(f"{base}/{name}")


def orient_from_stream(stream: DataFrame, name: str, k: int, radius: float, x_min: float, criterion: str = "hoppe", theta_s: float = 0.0, theta_acc: float = 0.5, min_extent: float | None = None, solver: str = "refined", by: str | None = None, late: str = "flag") -> DataFrame:
    """As orient.orient_stream, of a stream in x order alone: no second copy of the cloud is needed.

    The first pass keeps state of the points within a radius only. Late points are left out (or an error: late="raise")."""
    spark = stream.sparkSession
    base, _ = run_segments(stream, name, k, radius, x_min, criterion, theta_s, theta_acc, by, late)
    edges = spark.read.schema(EDGES + ", batch int").parquet(f"{base}/edges").groupBy("hi", "lo").agg(F.sum("weight").alias("weight"))
    signs = stored(solve(stored(edges, "edges"), solver).select(F.col("node").alias("segment"), "component", "sign"), "signs")
    return finished(second_pass(spark, base, f"oriented-{uuid.uuid4().hex}", signs), min_extent, strict=False)
