"""Ordered passes, slices, and axes by rotations."""

import numpy as np
import pytest
from makers import frame
from pyspark.sql import functions as F

from pointweave.operators import normals, ordered


def slices_of(x, width, most):
    """{place: slice}, one point after the other."""
    out, opened, number, n = [], None, 0, 0
    for v in x:
        if opened is None or v >= opened + width or n == most:
            opened, number, n = v, number + 1, 0
        n += 1
        out.append(number)
    return out


@pytest.mark.parametrize(("width", "most"), [(1.0, None), (0.25, None), (1.0, 7), (100.0, 1), (1e-9, None)])
def test_slices(spark, width, most):
    rng = np.random.default_rng(4)
    x = np.sort(np.concatenate([rng.integers(0, 40, 150) / 4, rng.uniform(0, 10, 50)]).astype("f4"))
    cloud = frame(spark, np.column_stack([x, x, x]), np.zeros((200, 3)))
    got = sorted((r.place, r.slice) for r in ordered.sliced(cloud, width, most).collect())
    assert got == list(enumerate(slices_of(x.astype(float), width, most), 1))
    assert ordered.sliced(cloud.where("false"), width, most).count() == 0


def test_folds_carry_over_ranges(spark, monkeypatch):
    """Ranges of a few rows, some of them empty: running numbers and gaps as of one pass."""
    x = np.random.default_rng(5).permutation(300).astype("f4") // 3
    cloud = frame(spark, np.column_stack([x, x, x]), np.zeros((300, 3))).repartition(9)
    rows = sorted(cloud.select("px", "id").collect())
    want = [(r.id, k + 1, r.px - (rows[k - 1].px if k else r.px)) for k, r in enumerate(rows)]
    assert sorted(map(tuple, ordered.gaps(cloud).collect())) == sorted(want)
    assert ordered.gaps(cloud.where("false")).count() == 0


def test_axes_are_those_of_eigh(spark):
    rng = np.random.default_rng(6)
    m = [a @ a.T for a in rng.normal(size=(200, 3, 3))] + [np.diag(d) for d in ([1, 2, 3], [3, 2, 1], [2, 1, 3.0])] + [np.outer(v, v) + np.outer(w, w) * 5 for v, w in rng.normal(size=(20, 2, 3))]
    m += [1e-12 * x for x in m[:20]] + [1e9 * x for x in m[:20]]
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]
    rows = [(k, *(float(x[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))) for k, x in enumerate(m)]
    got = normals.least_axis(spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)), names).orderBy("id").collect()
    for x, r in zip(m, got, strict=True):
        values, vectors = np.linalg.eigh(x)
        v = vectors[:, 0] * np.sign(vectors[np.abs(vectors[:, 0]).argmax(), 0])
        e = np.array([r.ex, r.ey, r.ez])
        assert abs(np.linalg.norm(e) - 1) < 1e-9 and e[np.abs(e).argmax()] > 0
        assert np.abs(e - v).max() < 1e-6 / min(1, (values[1] - values[0]) / values[2] + 1e-3)
    zero = normals.least_axis(spark.createDataFrame([(0, *[0.0] * 6)], "id long, " + ", ".join(f"{c} double" for c in names)), names).first()
    assert (zero.ex, zero.ey, zero.ez) == (1.0, 0.0, 0.0)


def test_normals_inside_slices(spark):
    """Against a loop: neighbours of the same slice and cell only."""
    rng = np.random.default_rng(7)
    p = np.column_stack([rng.uniform(0, 3, 160), rng.uniform(0, 1, 160), rng.normal(0, 0.02, 160)]).astype("f4")
    cloud, radius, most = frame(spark, p, np.zeros((160, 3))), 0.4, 25
    got = {r.id: np.array([r.nx, r.ny, r.nz]) for r in normals.estimated(cloud, radius, 20, max_per_slice=most).collect()}
    order = sorted(range(160), key=lambda k: (p[k, 0], k))
    number = dict(zip(order, slices_of([float(p[k, 0]) for k in order], 2 * radius, most), strict=True))
    q = p.astype(float)
    low = q.min(axis=0)
    key = {k: (number[k], *np.trunc((q[k, 1:] - low[1:]) / (2 * radius)).astype(int)) for k in range(160)}
    for k in range(160):
        near = sorted((((q[k] - q[j]) ** 2).sum(), j) for j in range(160) if j != k and key[j] == key[k])
        near = [j for d2, j in near if d2 < radius * radius][:20]
        if len(near) < 3:
            assert not got[k].any()
            continue
        d = q[near] - q[near].mean(axis=0)
        u = d / np.linalg.norm(d, axis=1)[:, None]
        own = q[k] - q[near].mean(axis=0)
        m = np.outer(own, own) + u.T @ u
        values = np.linalg.eigvalsh(m)
        assert abs(got[k] @ m @ got[k] - values[0]) < 1e-9
