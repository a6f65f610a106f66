import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from pointweave import shared
from pointweave.llm import queries, simhash

LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(own[k : k + 4]) for k in range(len(own) - 3)] if len(own) >= 4 else [" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, radius=4):
    """{fingerprint: least id reachable}, by all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for f, i in zip(fps, ids, strict=True):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in root}


def brute(rows, radius=4):
    fps = [fingerprint(t) for _, t in rows]
    found = components(fps, [i for i, _ in rows], radius)
    return sorted(((i, f"{f:016x}", found[f]) for (i, _), f in zip(rows, fps, strict=True)), key=str)


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_simhash(spark, sf).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_comparison(radius):
    """All pairs of random groups, near ones among them, of one to some hundred fingerprints."""
    rng = random.Random(radius)
    groups = []
    for n in (1, 2, 63, 64, 65, 200, 1, 130):
        base = rng.getrandbits(64)
        groups.append([base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9))) if rng.random() < 0.6 else rng.getrandbits(64) for _ in range(n)])
    flat = [f for g in groups for f in g]
    starts = np.cumsum([0, *map(len, groups[:-1])])
    runs = [(k, k) for k in range(len(groups))] + [(3, 5), (2, 0), (7, 4)]
    a, b = simhash.near_pairs(np.array(flat, dtype=np.uint64), starts, *np.array(runs).T, radius)
    want = set()
    for p, q in runs:
        pairs = combinations(range(len(groups[p])), 2) if p == q else ((i, j) for i in range(len(groups[p])) for j in range(len(groups[q])))
        want |= {(int(starts[p]) + i, int(starts[q]) + j) for i, j in pairs if (groups[p][i] ^ groups[q][j]).bit_count() <= radius}
    got = list(zip(a.tolist(), b.tolist(), strict=True))
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most", [2048, 40])
def test_links_of_clusters(spark, monkeypatch, most):
    """Chains and clusters of fingerprints, many of which share most of their bits; with few in a block, keys are refined and groups compared block by block."""
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "BLOCKS", 300)
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    monkeypatch.setattr(shared, "LEAST_HOT", 20)
    rng = random.Random(8)
    turned = lambda f, k: f ^ sum(1 << b for b in rng.sample(range(64), k))
    fps = {rng.getrandbits(64) for _ in range(300)} | {turned(0, rng.randrange(1, 7)) for _ in range(300)} | {0}
    chain = [rng.getrandbits(64)]
    for _ in range(60):
        chain.append(turned(chain[-1], rng.choice([3, 4, 4, 5])))
    fps = sorted(fps | set(chain))
    classes = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = simhash.connected(simhash.links(classes, len(fps), 4)).collect()
    part = {f % 2**64: c for f, c in ((r.node, r.component) for r in found)}
    want = components(fps, fps)
    for f in fps:
        assert (f in part) == any(want[f] == want[g] for g in fps if g != f)
    for a, b in combinations(list(part), 2):
        assert (part[a] == part[b]) == (want[a] == want[b])


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str) == brute(rows)
    assert simhash.near_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd, radius=8)


def test_repeated_ids_copies_and_long_texts(spark):
    long = " ".join(f"w{k % 70_000}" for k in range(300_000))
    rows = [(1, "a b c d e f"), (1, long), (5, long + " more"), (6, "A b C d e f"), (9, "x" * 2_000_000)] + [(20 + k, "the very same words again") for k in range(500)] + [(None, "the very same words again"), (None, "alone here")]
    want = brute(rows)
    assert sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want
    assert dict((x[0], x[2]) for x in want if x[0])[5] == 1
