import time

import numpy as np
import pytest
from makers import frame
from pyspark.sql import functions as F

from pointweave.operators import knn


def brute(rows, k, radius, causal=False):
    out = {}
    for a in rows:
        own = []
        for b in rows:
            if a[0] == b[0] or (causal and not (b[1], b[0]) < (a[1], a[0])):
                continue
            d2 = sum((float(x) - float(y)) ** 2 for x, y in zip(a[1:4], b[1:4]))
            if d2 < radius * radius:
                own.append((d2, b[0]))
        for rank, (d2, b) in enumerate(sorted(own)[:k], 1):
            out[a[0], rank] = (b, d2)
    return out


def clouds():
    rng = np.random.default_rng(0)
    yield "random", rng.uniform(-1, 1, (150, 3)), 0.4
    yield "lattice", np.array([(x, y, z) for x in range(5) for y in range(4) for z in range(3)]), 1.5
    yield "line", np.array([(x, 0, 0) for x in (0, 0.9, 1.8, 2.9, 3.8, 5.0)]), 1.0
    yield "one place", np.concatenate([np.zeros((90, 3)), rng.uniform(-0.1, 0.1, (20, 3))]), 0.5
    yield "dense", rng.normal(0, 0.05, (220, 3)), 1.0


@pytest.mark.parametrize(("name", "points", "radius"), list(clouds()))
@pytest.mark.parametrize("causal", [False, True])
def test_like_brute_force(spark, name, points, radius, causal):
    cloud = frame(spark, points, np.ones_like(points))
    rows = [tuple(r) for r in cloud.collect()]
    got = {(r.src, r["rank"]): (r.dst, r.d2) for r in (knn.knn_causal if causal else knn.knn_global)(cloud, 4, radius).collect()}
    want = brute(rows, 4, radius, causal)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_edges_of_input(spark):
    assert knn.knn_global(frame(spark, [], []), 3, 1.0).count() == 0
    assert knn.knn_global(frame(spark, [(0, 0, 0)], [(0, 0, 1)]), 3, 1.0).count() == 0
    odd = spark.sql("select 1L id, float('nan') px, 0f py, 0f pz, 0f nx, 0f ny, 1f nz union all select null, 0f, 0f, 0f, 0f, 0f, 1f union all select 2, null, 0f, 0f, 0f, 0f, 1f union all select 3, 0f, 0f, 0f, 0f, 0f, 1f union all select 4, 0f, 0f, 0.5f, 0f, 0f, 1f")
    assert sorted((r.src, r.dst) for r in knn.knn_global(odd, 3, 1.0).collect()) == [(3, 4), (4, 3)]
    for k, r in ((0, 1.0), (1, 0.0)):
        with pytest.raises(ValueError):
            knn.knn_global(odd, k, r)


def test_cells_in_dense_clouds(spark):
    """Neighbours of the same key only, like brute force; in a dense cloud few pairs are looked at (2 * 10^8 are within the radius, which the sort would hold), points at one place and null keys included."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 0.05, (200, 3)), np.zeros((30, 3))])
    cloud = frame(spark, points, points)
    key = F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3)
    got = {(r.src, r["rank"]): r.dst for r in knn.knn_cell(cloud, 5, 1.0, key).collect()}
    rows, want = [tuple(r) for r in cloud.collect()], {}
    for c in range(3):
        want |= {k: v[0] for k, v in brute([r for r in rows if r[0] % 7 and r[0] % 3 == c], 5, 1.0).items()}
    assert got == want
    dense = frame(spark, rng.normal(0, 0.1, (15_000, 3)), np.zeros((15_000, 3)))
    start = time.perf_counter()
    assert knn.knn_cell(dense, 5, 1.0, F.lit(1)).count() == 75_000
    assert time.perf_counter() - start < 100
