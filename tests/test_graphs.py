import random

import numpy as np
import pytest
from makers import frame, strip
from pyspark.sql import functions as F

from unionfind import SignedUnionFind
from pointweave import shared
from pointweave.operators import components, forest, graph, refine, segment
from pointweave.operators.knn import neighbours
from pointweave.operators.transform import normalized


def kruskal(edges):
    """Forest edges and {node: (least node, sign)}, by sorting and a signed union-find."""
    nodes = sorted({x for hi, lo, _ in edges for x in (hi, lo)})
    at, u, taken = {x: k for k, x in enumerate(nodes)}, SignedUnionFind(), []
    for _ in nodes:
        u.add()
    for hi, lo, w in sorted(edges, key=lambda e: (-abs(e[2]), e[0], e[1])):
        if u.representative(at[hi]) != u.representative(at[lo]):
            if (u.negative(at[hi]) != u.negative(at[lo])) != (w < 0):
                u.flip(at[hi])
            u.merge(at[hi], at[lo])
            taken.append((hi, lo))
    least = {}
    for x in nodes:
        least.setdefault(u.representative(at[x]), x)
    root = {x: least[u.representative(at[x])] for x in nodes}
    return sorted(taken), {x: (root[x], 1 if u.negative(at[x]) == u.negative(at[root[x]]) else -1) for x in nodes}


def some_edges(seed, n=120, m=260, ties=False):
    rng = random.Random(seed)
    pairs = {(max(a, b), min(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}
    return [(a, b, float(rng.choice([-1, 0, 1, 2])) if ties else rng.uniform(-1, 1)) for a, b in sorted(pairs)]


@pytest.mark.parametrize(("seed", "ties"), [(0, False), (1, True), (2, True)])
def test_forest(spark, seed, ties):
    edges = some_edges(seed, ties=ties)
    tree, solution = forest.spanning_forest(spark.createDataFrame(edges, "hi long, lo long, weight double"))
    taken, signs = kruskal(edges)
    assert sorted((r.hi, r.lo) for r in tree.collect()) == taken
    assert {r.node: (r.component, r.sign) for r in solution.collect()} == signs


def test_forest_of_a_path_and_of_nothing(spark):
    path = [(k + 1, k, (-1.0) ** k * (1 + k % 7)) for k in range(200)]
    _, solution = forest.spanning_forest(spark.createDataFrame(path, "hi long, lo long, weight double"))
    assert {r.node: (r.component, r.sign) for r in solution.collect()} == kruskal(path)[1]
    odd = spark.createDataFrame([(1, 1, 1.0), (None, 2, 1.0), (3, 2, None), (5, 4, float("nan"))], "hi long, lo long, weight double")
    tree, solution = forest.spanning_forest(odd)
    assert tree.count() == solution.count() == 0


def test_refinement_never_costs(spark):
    for seed in (3, 4):
        edges = spark.createDataFrame(some_edges(seed), "hi long, lo long, weight double")
        _, first = forest.spanning_forest(edges)
        second = refine.refined(edges, first)
        before, after = (graph.model_energy(edges, s).first().energy for s in (first, second))
        assert after <= before + 1e-9
        assert second.where("node = component and sign != 1").isEmpty()
        rows = {r.node: r.sign for r in second.collect()}
        for x in {r.node for r in second.where("node != component").collect()}:  # no single flip helps any more
            assert sum(w * rows[a] * rows[b] for a, b, w in some_edges(seed) if x in (a, b)) >= -1e-8


def test_components(spark):
    edges = some_edges(9, n=300, m=200)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame([e[:2] for e in edges], "a long, b long")).collect()}
    assert got == {x: c for x, (c, _) in kruskal(edges)[1].items()}


def test_component_filters_and_ranks(spark):
    cloud = frame(spark, [(0, 0, 0), (2, 2, 2), (9, 9, 9), (9, 10, 10), (9.5, 9, 9)], [(0, 0, 1)] * 5).withColumn("component", F.when(F.col("id") < 2, 0).otherwise(2).cast("long"))
    boxes = components.boxes(cloud)
    kept = lambda *a, **b: {r.component: r.kept for r in components.large_enough(boxes, *a, **b).collect()}
    assert kept(0.5) == {0: True, 2: True} and kept(0.5, strict=True) == {0: True, 2: False} and kept(None) == {0: True, 2: True}
    assert {r.component: r.comp_rank for r in components.by_size(components.large_enough(boxes, None)).collect()} == {2: 0, 0: 1}


def best_segment(asked, standing, theta_s, theta_acc):
    """The rule for one point. asked: {segment: [(squared distance, vote)]} of its neighbours; returns (segment or None, total)."""
    total = {s: sum(v for _, v in x) for s, x in asked.items()}
    nearest = {s: min(d for d, _ in x) for s, x in asked.items()}
    reach = {s for s in asked if nearest[s] <= 1.69 * min(nearest.values())}
    torn = {s for s, x in asked.items() if sum(v for _, v in x if v > 0) > theta_s and sum(-v for _, v in x if v < 0) > theta_s}
    strong = {s for s in asked if abs(total[s]) >= theta_acc}
    fits = {s for s in reach & strong - torn if all(abs(total[t]) <= theta_s or total[t] * (1 if total[s] > 0 else -1) * standing.get(frozenset((s, t)), 0) >= 0 for t in asked if t != s)}
    pick = max(fits, key=lambda s: (abs(total[s]), nearest[s], s), default=None)
    return pick, total


def one_sweep(rows, near, radius, theta_s, theta_acc):
    """Segments and flips of all points in their order; normals turn as the sweep goes on."""
    normal = {r["id"]: np.array([r[c] for c in ("nx", "ny", "nz")], dtype=float) for r in rows}
    place, standing = {}, {}
    for v in (r["id"] for r in sorted(rows, key=lambda r: (r["px"], r["id"]))):
        asked = {}
        for n, d2 in near.get(v, []):
            asked.setdefault(place[n][0], []).append((d2, float(normal[v] @ normal[n]) * (1 - d2 / radius**2)))
        pick, total = best_segment(asked, standing, theta_s, theta_acc)
        flip = -1 if pick is not None and total[pick] < 0 else 1
        normal[v] = normal[v] * flip
        place[v] = (v if pick is None else pick, flip)
        for t in set(asked) - {place[v][0]}:
            standing[frozenset((place[v][0], t))] = standing.get(frozenset((place[v][0], t)), 0) + total[t] * flip
    return place, {tuple(sorted(k, reverse=True)): w for k, w in standing.items()}


def test_the_rule_on_small_cases():
    """Hand-worked: nearest, torn, weak, upset, flipped."""
    rule = lambda asked, standing=None, theta_s=0.0, theta_acc=0.5: best_segment(asked, standing or {}, theta_s, theta_acc)[0]
    for case, want in [
        ({}, None), ({1: [(1.0, 0.4)]}, None), ({1: [(1.0, 0.6)]}, 1), ({1: [(1.0, -0.6)]}, 1), ({1: [(1.0, 0.9), (1.0, -0.1)]}, None),
        ({1: [(1.0, 0.6)], 2: [(1.6, 0.8)]}, 2), ({1: [(1.0, 0.6)], 2: [(1.7, 0.8)]}, 1),
    ]:
        assert rule(case) == want
        sweep = segment.Sweep(0.0, 0.5)
        sweep.placed = {10 * s + k: (s, 1) for s, x in case.items() for k in range(len(x))}
        sweep.add(99, [(10 * s + k, v, d) for s, x in case.items() for k, (d, v) in enumerate(x)])
        assert sweep.placed[99] == (99 if want is None else want, -1 if want and case[want][0][1] < 0 else 1)
    both = {1: [(1.0, 0.6)], 2: [(1.0, 0.8)]}
    assert rule(both, {frozenset((1, 2)): -0.1}) is None and rule(both, {frozenset((1, 2)): 0.1}) == 2 and rule(both, {frozenset((1, 2)): -0.1}, theta_s=0.7) == 2


@pytest.mark.parametrize(("theta_s", "theta_acc"), [(0.0, 0.5), (0.1, 0.3)])
def test_segmentation(spark, theta_s, theta_acc):
    """One sweep, whatever the size of the pieces: a strip, smaller components beside it, and points without neighbours."""
    (p, n), (q, m) = strip(250), strip(40)
    p = np.concatenate([p, q + 5, [(50, 0, 0), (60, 1, 1)]])
    n = np.concatenate([n, m, [(0, 0, 1), (1, 0, 0)]])
    n = n * np.random.default_rng(2).choice([-1, 1], len(n))[:, None]
    cloud = normalized(frame(spark, p, n, start=2**60)).cache()  # ids that no double holds
    near = neighbours(cloud, 6, 0.4, causal=True).cache()
    lists = {}
    for r in near.collect():
        lists.setdefault(r.a_id, []).append((r.b_id, r.d2))
    want, edges = one_sweep([r.asDict() for r in cloud.collect()], lists, 0.4, theta_s, theta_acc)
    segments = segment.segmented(cloud, near, "hoppe", 0.4, theta_s, theta_acc, most=10**6).cache()
    assert {r.id: (r.segment, r.flip) for r in segments.collect()} == want and segments.count() == 292
    got = {(r.hi, r.lo): r.weight for r in graph.segment_edges(near, segments, "hoppe", 0.4).collect()}
    assert got.keys() == edges.keys() and all(abs(got[k] - edges[k]) < 1e-9 for k in got)
    for most in (60, 250) if theta_s else (23,):
        assert {r.id: (r.segment, r.flip) for r in segment.segmented(cloud, near, "hoppe", 0.4, theta_s, theta_acc, most=most).collect()} == want


def test_hot_keys_are_looked_up_apart(spark, monkeypatch):
    """Joins with every key hot, some, or none give what a plain join gives."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.choice([None, 0, 0, 0, 1, 1, 2, 9]), k) for k in range(300)], "key int, n int")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (5, "c")], "key int, name string")
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(table, "key", how).collect()))
        for least in (0, 40, 1000):
            monkeypatch.setattr(shared, "LEAST_HOT", least)
            assert sorted(map(str, shared.looked_up(rows, table, "key", 300 if least else 1, how).collect())) == want


def test_large_stars(spark):
    """A star of 100,000 leaves, as components and as a forest."""
    edges = spark.range(1, 100_001).selectExpr("id as hi", "0L as lo", "if(id % 3 = 0, -1.0, 1.0) * (1 + id) as weight")
    found = components.connected(edges.selectExpr("hi as a", "lo as b"))
    assert found.count() == 100_001 and found.where("component != 0").isEmpty()
    taken, solution = forest.spanning_forest(edges)
    assert taken.count() == 100_000
    assert solution.where("component != 0 or sign != if(node > 0 and node % 3 = 0, -1, 1)").isEmpty() and solution.count() == 100_001
