import math

import numpy as np
import pytest
from makers import frame, sphere, strip
from pyspark.sql import functions as F

from pointweave import cli, shared
from pointweave.functions import criteria
from pointweave.operators import compare, graph, normals, ranking, stats, transform
from pointweave.plans import orient
from pointweave.sources import clouds


def two_spheres(spark):
    (p, n), (q, m) = sphere(300), sphere(120, (10, 0, 0))
    return frame(spark, np.concatenate([p, q]), np.concatenate([n, m]))


@pytest.mark.parametrize("criterion", ["hoppe", "xie"])
@pytest.mark.parametrize("way", [orient.orient_global, orient.orient_stream])
def test_random_signs_become_consistent(spark, way, criterion):
    truth = two_spheres(spark)
    got = way(transform.randomized(truth, 3), 6, 0.5, criterion).cache()
    by = {r.component: (r.agree, r.n) for r in orient.accuracy(got, truth).collect()}
    assert sorted(n for _, n in by.values()) == [120, 300] and all(agree in (0, n) for agree, n in by.values())
    assert {r.comp_rank for r in got.where("px < 5").select("comp_rank").distinct().collect()} == {0}


def test_small_components_go(spark):
    p, n = sphere(200)
    flat = np.array([(x / 5 + 20, y / 5, 0) for x in range(6) for y in range(6)])
    cloud = frame(spark, np.concatenate([p, flat]), np.concatenate([n, [(0, 0, 1)] * 36]))
    assert orient.orient_global(cloud, 6, 0.5, min_extent=0.5).count() == 200
    assert orient.orient_global(cloud, 6, 0.5).count() == 236


def test_a_strip_has_edges_that_do_not_fit(spark):
    p, n = strip()
    edges = graph.edges_global(frame(spark, p, n), 6, 0.4)
    solution = orient.solve(edges, "forest")
    assert graph.unorientable(edges, solution).first().unorientable > 0
    plain = solution.withColumn("sign", F.lit(1))
    energy = [graph.model_energy(edges, s).first().energy for s in (plain, solution, orient.solve(edges))]
    assert energy[2] <= energy[1] + 1e-9
    assert orient.solve(edges, "components").where("sign != 1").isEmpty()
    with pytest.raises(ValueError):
        orient.solve(edges, "other")


def test_slabs_bound_the_energy(spark):
    truth = two_spheres(spark)
    edges = graph.edges_global(truth, 6, 0.5)
    best = graph.energy(edges).first().energy
    for slab in (50, 1000):
        got = orient.orient_stream(transform.randomized(truth, 5), 6, 0.5, slab_points=slab)
        assert graph.energy(graph.edges_global(got, 6, 0.5)).first().energy <= best + 1e-6


def test_estimated_normals(spark):
    p, n = sphere(400)
    got = {r.id: (r.nx, r.ny, r.nz) for r in normals.estimated(frame(spark, p, 0 * n), 0.4).collect()}
    assert np.mean([abs(np.dot(got[k], n[k])) for k in range(400)]) > 0.99
    lone = normals.estimated(frame(spark, [(0, 0, 0), (0.1, 0, 0), (0, 0.1, 0)], [(0, 0, 1)] * 3), 0.5).collect()
    assert all((r.nx, r.ny, r.nz) == (0, 0, 0) for r in lone)


def test_preparation_can_be_undone(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(300, 3)) * [1, 5, 2] + [3, -2, 7]
    done = orient.prepare(frame(spark, p, p))
    rot, rows = np.array(done.rotation), {r.id: r for r in done.cloud.collect()}
    assert np.allclose(rot @ rot.T, np.eye(3)) and np.linalg.det(rot) == pytest.approx(1)
    back = np.array([[rows[k].px, rows[k].py, rows[k].pz] for k in range(300)]) @ rot + done.centroid
    assert np.allclose(back, p, atol=1e-4)
    spread = np.var([[r.px, r.py, r.pz] for r in rows.values()], axis=0)
    assert spread[0] > spread[1] > spread[2]
    assert [r.id for r in sorted(rows.values(), key=lambda r: r.ord)] == [r.id for r in sorted(rows.values(), key=lambda r: (r.px, r.id))]


def test_comparison(spark):
    a = frame(spark, [(0, 0, 0), (0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)], [(0, 0, 1), (0, 0, -1), (0, 0, 1), (0, 0, 0), (0, 1, 0)])
    b = frame(spark, [(0, 0, 0), (0, 0, 0), (1, 0, 0), (2, 0, 0), (9, 0, 0), (9, 1, 0)], [(0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 1, 0), (0, 1, 0)])
    assert tuple(compare.compare_normals(a, b).first()) == (2, 2, 1, 2)


def test_rows_and_keys(spark):
    rows = [(1, 0.0, 0.0, 0.0, 3.0, 0.0, 4.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0, float("nan"), 0.0, 1.0)]
    cloud = spark.createDataFrame(rows, "id long, px float, py float, pz float, nx float, ny float, nz float")
    assert [r.id for r in transform.valid_normals(cloud).collect()] == [1]
    got = {r.id: (r.nx, r.ny, r.nz) for r in transform.normalized(cloud).collect()}
    assert got[1] == pytest.approx((0.6, 0, 0.8)) and got[2] == (0, 0, 0) and math.isnan(got[3][0])
    two = spark.range(1).select(transform.morton(F.lit(0b1011), F.lit(0b0110)).alias("m")).first().m
    assert two == sum(((0b1011 >> k) & 1) << 2 * k | ((0b0110 >> k) & 1) << 2 * k + 1 for k in range(16))
    colors = {r.id: (r.red, r.green, r.blue) for r in spark.range(4).withColumns(transform.segment_color(F.col("id"))).collect()}
    import colorsys

    for s, c in colors.items():
        assert c == tuple(int(x * 255 + 1e-9) for x in colorsys.hsv_to_rgb((3 * s % 13) / 13, 1, 0.5 + 0.5 * (s % 2)))
    assert criteria.criterion("XIE") is criteria.xie
    with pytest.raises(ValueError):
        criteria.criterion("other")
    flips = [[r.nx for r in transform.randomized(frame(spark, [(0, 0, 0)] * 200, [(1, 0, 0)] * 200), s).orderBy("id").collect()] for s in (1, 1, 2)]
    assert flips[0] == flips[1] != flips[2] and 60 < sum(x > 0 for x in flips[0]) < 140
    assert transform.batched(cloud, lambda part: part[["id"]] + 1, "id long").agg(F.sum("id")).first()[0] == 9


def test_statistics(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.exponential(1, 500).cumsum(), 2).astype("f4")
    cloud = frame(spark, np.column_stack([x, x * 0, x * 0]), np.ones((500, 3))).repartition(7)
    for width in (0.5, 7.0, 60.0, 1e6):
        start, largest, n = None, 0, 0
        for v in map(float, x):
            if start is None or v >= start + width:
                largest, start, n = max(largest, n), v, 0
            n += 1
        assert stats.slice_size(cloud, width) == (largest or 500)
    ranks = {r.id: r.ord for r in ranking.ranked(cloud.select("id", "px"), [F.desc("px"), F.asc("id")], "ord").collect()}
    assert [i for i, _ in sorted(ranks.items(), key=lambda z: z[1])] == sorted(range(500), key=lambda k: (-float(x[k]), k)) and sorted(ranks.values()) == list(range(1, 501))
    assert stats.slice_size(cloud.where("false"), 1.0) == 0


def test_command_line(spark, tmp_path):
    p, n = sphere(150)
    (tmp_path / "ball.xyz").write_text("\n".join(" ".join(f"{x:.6g}" for x in (*a, *b)) for a, b in zip(p, n)) + "\n")
    for options in (["-randomize"], ["-stream", "-prepare", "-calculateEnergies", "-flipcrit", "xie", "-randomize"]):
        (tmp_path / "ball_oriented").rename(tmp_path / "first") if (tmp_path / "ball_oriented").exists() else None
        out = cli.run(spark, [str(tmp_path / "ball.xyz"), "-r", "0.6", *options])
        got = clouds.read_ply(spark, f"{out}/largest.ply")
        dots = [r.px * r.nx + r.py * r.ny + r.pz * r.nz for r in got.collect()] if "-prepare" not in options else [1.0] * got.count()
        assert len(dots) == 150 and (all(d > 0 for d in dots) or all(d < 0 for d in dots))
    with pytest.raises(SystemExit) as stop:
        cli.run(spark, ["x.ply", "-nothing"])
    assert stop.value.code != 0


def test_many_points_at_one_position(spark, monkeypatch):
    """Numbering by rank, as for positions with very many points, against the numbering in one window."""
    cloud = frame(spark, [(k % 3 == 0, 0, 0) for k in range(90)], [(0, 0, 1)] * 90)
    other = frame(spark, [(k % 4 == 0, 0, 0) for k in range(80)], [(0, 0, (-1) ** (k // 2)) for k in range(80)])
    want = tuple(compare.compare_normals(cloud, other).first())
    monkeypatch.setattr(compare, "MOST_AT_ONE", 5)
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    monkeypatch.setattr(shared, "LEAST_HOT", 4)
    assert tuple(compare.compare_normals(cloud, other).first()) == want
    row = compare.compare_normals(spark.range(100_000).selectExpr("id", *(f"0f {c}" for c in ("px", "py", "pz", "nx", "ny")), "1f nz"), cloud.where("px = 0")).first()
    assert tuple(row) == (60, 0, 100_000 - 60, 0)


def test_the_coin_is_a_hash_of_id_and_seed(spark):
    """The sign of each point, reckoned again: XXH64 of the id, then of the seed."""
    import struct

    import xxhash

    p, n = sphere(200)
    for seed in (0, 7):
        got = {r.id: np.sign(r.nz) for r in transform.randomized(frame(spark, p, np.tile((0, 0, 1), (200, 1))), seed).collect()}
        coin = lambda k: xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(struct.pack("<q", k), 42)) & 1  # noqa: B023, E731
        assert got == {k: -1 if coin(k) else 1 for k in range(200)}
