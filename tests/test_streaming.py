import time

import numpy as np
import pytest
from makers import frame, sphere
from pyspark.sql import functions as F

from pointweave import queries
from pointweave.operators import graph, knn, ranking, segment, transform
from pointweave.plans import orient
from pointweave.shared import shared_dir
from pointweave.sources import clouds, sinks
from pointweave.streaming import orient as stream_orient
from pointweave.streaming import segments, sweep


def files_in_x_order(spark, cloud, folder, n):
    """One file after the other, as a stream takes them in order of their times."""
    for k in range(n):
        low, high = -1 + 2 * k / n, -1 + 2 * (k + 1) / n
        cloud.where((F.col("px") >= low) & ((F.col("px") < high) | F.lit(k == n - 1))).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(cloud.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_sweep_finds_what_the_batch_finds(spark, tmp_path):
    p, n = sphere(200)
    cloud = frame(spark, p, n)
    stream = files_in_x_order(spark, cloud, str(tmp_path / "a"), 4)
    got = knn.as_knn(sweep.run_sweep(stream, f"test-{tmp_path.name}-a", 6, 0.5, -1.0)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, knn.knn_causal(cloud, 6, 0.5).collect()))


def test_sweep_goes_on_and_makes_no_pairs_beyond_k(spark, tmp_path):
    """In a dense cloud, stopped halfway and out of order within a radius: the batch's neighbours; only each point's k nearest are ever written, and the points kept lie within two radii."""
    rng = np.random.default_rng(4)
    points = rng.normal(0, 0.2, (1500, 3))
    points[:40] = points[0]  # many at one place
    order = np.argsort(points[:, 0] + rng.uniform(-0.1, 0.1, 1500))
    cloud, folder, name = frame(spark, points, points), str(tmp_path / "points"), f"test-{tmp_path.name}"
    for k, part in enumerate(np.array_split(order, 3)):
        cloud.where(F.col("id").isin(part.tolist())).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
        if k:
            stream = spark.readStream.schema(cloud.schema).option("maxFilesPerTrigger", 1).parquet(folder)
            got = knn.as_knn(sweep.run_sweep(stream, name, 6, 0.5, -2.0)).collect()
            here = cloud.where(F.col("id").isin(np.concatenate(np.array_split(order, 3)[: k + 1]).tolist()))
            assert sorted(map(tuple, got)) == sorted(map(tuple, knn.knn_causal(here, 6, 0.5).collect()))
    base = f"{shared_dir(spark)}/{name}"
    written = spark.read.parquet(f"{base}/near")
    assert written.count() <= 6 * 1500 and written.groupBy("a_id").count().where("count > 6").isEmpty()
    assert sorted(sweep.folders(spark, f"{base}/held")) == [1, 2]
    width = spark.read.parquet(f"{base}/held").groupBy("batch").agg((F.max("px") - F.min("px")).alias("w")).collect()
    assert all(r.w <= 1.0 for r in width)
    assert sorted(map(tuple, knn.as_knn(sweep.run_sweep(stream, name, 6, 0.5, -2.0)).collect())) == sorted(map(tuple, got))


def test_sweep_of_records_in_a_dense_cloud(spark, tmp_path):
    """From records, so many a batch: the batch's neighbours, and no more rows written than k a point (there are 1,246,438 pairs within the radius)."""
    points, path = np.random.default_rng(6).normal(0, 0.2, (2000, 3)), f"file://{tmp_path}/records"
    cloud = in_x_order(spark, frame(spark, points, points), path)
    got = knn.as_knn(sweep.run_sweep(clouds.read_bin_stream(spark, path, 700), f"test-{tmp_path.name}", 6, 0.5, -2.0)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, knn.knn_causal(cloud, 6, 0.5).collect()))
    base = f"{shared_dir(spark)}/test-{tmp_path.name}"
    assert max(sweep.folders(spark, f"{base}/near")) == 2 and spark.read.parquet(f"{base}/near").count() <= 6 * 2000


def test_votes_as_arrays(spark):
    """The arrays' votes are the columns'."""
    (p, n), rng = sphere(40), np.random.default_rng(3)
    cloud = transform.normalized(frame(spark, np.concatenate([p, p[:5]]), rng.normal(size=(45, 3))))
    rows = {r.id: np.array([r.px, r.py, r.pz, r.nx, r.ny, r.nz], dtype=float) for r in cloud.collect()}
    for name in ("hoppe", "xie"):
        near = knn.neighbours(cloud, 6, 0.5).select("a_id", "b_id", "d2", segment.vote(name, "a", "b", 0.5).alias("vote")).collect()
        for r in near:
            assert segments.votes_of(name, rows[r.a_id], rows[r.b_id][None], np.array([r.d2]), 0.5)[0] == r.vote


def test_nearest_before_in_dense_clouds():
    """The stream's search against brute force, also with ties, many points at one place and far out; in a dense cloud it does not look at all pairs within the radius."""
    rng = np.random.default_rng(0)
    for n, points in ((300, rng.normal(0, 0.1, (300, 3))), (200, rng.integers(0, 4, (200, 3)) * 0.25), (150, np.zeros((150, 3))), (100, rng.uniform(-1, 1, (100, 3)) * 1e12), (0, np.zeros((0, 3)))):
        ids = rng.permutation(n)
        order = np.lexsort((ids, points[:, 0]))
        points, ids = points[order], ids[order]
        want = []
        for a in range(n // 3, n):
            d = points[a] - points[:a]
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            want += [(a, b, d2[b]) for b in [b for b in np.lexsort((ids[:a], d2)) if d2[b] < 0.25][:6]]
        assert list(zip(*(x.tolist() for x in segments.nearest_before(points, ids, n // 3, 6, 0.5)), strict=True)) == want
    points = rng.normal(0, 0.1, (60_000, 3))
    points = points[np.argsort(points[:, 0])]
    start = time.process_time()
    a, _, _ = segments.nearest_before(points, np.arange(60_000), 0, 6, 0.5)
    assert len(a) > 359_000 and time.process_time() - start < 60  # 10^9 pairs are within the radius


def in_x_order(spark, cloud, path):
    """The cloud as binary records in x order, whose ids are the records' numbers."""
    ranks = ranking.ranked(cloud, [F.col("px"), F.col("id")], "ord").withColumn("id", F.col("ord") - 1).drop("ord")
    sinks.write_bin(ranks, path)
    return clouds.read_bin(spark, path)


@pytest.mark.parametrize("criterion", ["hoppe", "xie"])
def test_segments_of_a_stream(spark, tmp_path, criterion):
    """A stream of 100 records a batch finds the batch's segments and edges on cloud E; the state holds a part of the points only."""
    path = f"file://{tmp_path}/e.bin"
    cloud = transform.normalized(in_x_order(spark, queries.cloud_e(spark, "/root/testdata/sf0.001"), path))
    near = knn.neighbours(cloud, 6, 0.1, causal=True).cache()
    placed = segment.segmented(cloud, near, criterion, 0.1).cache()
    base, late = stream_orient.run_segments(clouds.read_bin_stream(spark, path, 100), f"test-{tmp_path.name}", 6, 0.1, -1.0, criterion)
    got = spark.read.parquet(f"{base}/points")
    assert sorted(map(tuple, got.select("id", "segment", "flip").collect())) == sorted(map(tuple, placed.select("id", "segment", "flip").collect()))
    assert got.select("batch").distinct().count() == 5 and late.late == 0 and len(late.held) == 5 and max(late.held) < 250
    want = {(r.hi, r.lo): r.weight for r in graph.segment_edges(near, placed, criterion, 0.1).collect()}
    edges = {(r.hi, r.lo): r.weight for r in spark.read.parquet(f"{base}/edges").groupBy("hi", "lo").agg(F.sum("weight").alias("weight")).collect()}
    assert edges.keys() == want.keys() and all(abs(edges[k] - want[k]) < 1e-9 for k in want)
    # a batch that comes again changes nothing
    again = got.where("batch = 2").select("*", F.lit(segments.POINT).alias("kind"), *(F.lit(0).cast(t).alias(c) for c, t in (("hi", "long"), ("lo", "long"), ("weight", "double"), ("held", "long"))))
    rows = sorted(map(tuple, got.collect()))
    stream_orient.first_pass(base)(spark.createDataFrame(again.collect(), again.schema), 2)
    assert sorted(map(tuple, spark.read.parquet(f"{base}/points").collect())) == rows


def test_orientation_from_a_stream_alone(spark, tmp_path):
    """Stopped halfway and started again, two clouds at once: the result of the batch on each."""
    p, n = sphere(150)
    truth = frame(spark, np.concatenate([p, p + [0, 5, 0]]), np.concatenate([n, n]))
    cloud = transform.randomized(truth, 1).select("id", *(F.col(c).cast("float").alias(c) for c in segments.PLACE), (F.col("py") > 2).cast("string").alias("scan"))
    folder = str(tmp_path / "points")
    name = f"test-{tmp_path.name}"
    for k in range(3):
        cloud.where((F.col("px") >= -1.1 + k * 0.8) & (F.col("px") < -0.3 + k * 0.8)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
        if k == 1:
            stream = spark.readStream.schema(cloud.schema).option("maxFilesPerTrigger", 1).parquet(folder)
            stream_orient.run_segments(stream, name, 6, 0.5, -1.1, by="scan")
    got = stream_orient.orient_from_stream(stream, name, 6, 0.5, -1.1, by="scan").cache()
    want = orient.orient_stream(cloud.drop("scan"), 6, 0.5)
    columns = ["id", "segment", "component", "comp_rank", "red", "green", "blue"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert all(r.agree in (0, r.n) for r in orient.accuracy(got, truth).collect()) and got.count() == 300


@pytest.mark.parametrize("by", [0.3, 2.0])
def test_late_points_are_counted(spark, tmp_path, by):
    """One point comes late, within a radius of the watermark (flagged) or beyond it (dropped): it is counted, takes no part, or is an error."""
    p, n = sphere(200)
    cloud = frame(spark, p, n)
    folder = str(tmp_path / "d")
    late = cloud.where(F.col("px").between(0.45 - by, 0.55 - by) if by < 1 else "px < -0.9").limit(1).select(F.lit(9999).cast("long").alias("id"), *cloud.columns[1:])
    for k in range(4):
        part = cloud.where((F.col("px") >= -1 + k / 2) & ((F.col("px") < -0.5 + k / 2) | F.lit(k == 3)))
        (part.union(late) if k == 3 else part).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema(cloud.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    base, seen = stream_orient.run_segments(stream, f"test-{tmp_path.name}", 6, 0.5, -1.0)
    assert seen.late == 1 and (seen.flagged, seen.dropped) == ((1, 0) if by < 1 else (0, 1))
    assert spark.read.parquet(f"{base}/points").where("not late").count() == 200
    with pytest.raises(ValueError, match="1 points came late"):
        stream_orient.run_segments(stream, f"test-{tmp_path.name}-again", 6, 0.5, -1.0, late="raise")


def test_records_as_a_stream(spark, tmp_path):
    """So many records a batch, over two files; it goes on after a restart, also with records added meanwhile."""
    (p, n), folder = sphere(130), tmp_path / "records"
    sinks.write_bin(frame(spark, p[:100], n[:100]), f"file://{folder}/a.bin")
    path, name = f"file://{folder}/a.bin", f"records{abs(hash(str(tmp_path)))}"

    def run():
        query = clouds.read_bin_stream(spark, path, 30).writeStream.format("parquet").queryName(name).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        sizes = [q["numInputRows"] for q in query.recentProgress if q["numInputRows"]]
        query.stop()
        return sizes

    assert sum(first := run()) == 100 and max(first) == 30
    sinks.write_bin(frame(spark, p[100:], n[100:]), f"file://{tmp_path}/more.bin")
    for file in sorted((tmp_path / "more.bin").glob("part*")):
        file.rename(folder / "a.bin" / f"z-{file.name}")
    assert sum(run()) == 30 and run() == []
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(130)) and [r.px for r in got] == [np.float32(x) for x in p[:, 0]]


def test_late_points_are_dropped(spark, tmp_path):
    """A point that comes long after its neighbours along x finds none and is found by none; the others are as without it."""
    p, n = sphere(200)
    cloud = frame(spark, p, n)
    folder = str(tmp_path / "c")
    late = cloud.where("px < -0.9").limit(1).select(F.lit(9999).cast("long").alias("id"), *cloud.columns[1:])
    for k in range(4):
        part = cloud.where((F.col("px") >= -1 + k / 2) & ((F.col("px") < -0.5 + k / 2) | F.lit(k == 3)))
        (part.union(late) if k == 3 else part).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema(cloud.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = knn.as_knn(sweep.run_sweep(stream, f"test-{tmp_path.name}-c", 6, 0.3, -1.0)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, knn.knn_causal(cloud, 6, 0.3).collect()))
