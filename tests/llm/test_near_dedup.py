import random
import re
from itertools import combinations

import pytest

from pointweave import shared
from pointweave.llm import near_dedup as nd


def shingle_set(text, words=5):
    own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not own:
        return set()
    return {tuple(own[k : k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else {tuple(own)}


def brute(texts, percent):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


def edited(rng, text, edits):
    own = text.split()
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
    return " ".join(own)


@pytest.mark.parametrize(("percent", "rows", "bands"), [(85, 6, 36), (80, 5, 40)])
def test_documents_and_copies(spark, documents, percent, rows, bands):
    rng = random.Random(5)
    texts = {r.doc_id: r.text for r in documents.limit(120).collect()}
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(150))
    texts |= {1000 + k: edited(rng, base, k % 6) for k in range(260)}  # more than a block holds, about the limit
    got = nd.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent, rows, bands).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark, odd, none):
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    got = nd.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    want = brute(texts, 80)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert nd.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(260)] + [(5, 5), (None, 3), (7, 6), (6, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = nd.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in root}
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_ids_with_other_texts(spark):
    """Each text of an id that comes twice is linked with its own near copies."""
    text = lambda w: " ".join(f"{w}{k}" for k in range(200))
    rows = [(1, text("a")), (1, text("b")), (5, text("a") + " more"), (6, text("b") + " more"), (6, text("b") + " more"), (7, text("c"))]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (6, 1, False), (7, 7, True)]


def test_hot_classes_and_bands(spark, documents, monkeypatch):
    """The same with every key of some rows hot, and with a filter so small that it passes all texts."""
    want = sorted(map(tuple, nd.near_duplicates(documents.union(documents)).collect()))
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    monkeypatch.setattr(shared, "LEAST_HOT", 2)
    monkeypatch.setattr(nd, "FILTER_BITS", 64)
    assert sorted(map(tuple, nd.near_duplicates(documents.union(documents)).collect())) == want


def test_very_long_texts(spark):
    base = " ".join(f"w{k}" for k in range(400_000))
    rows = [(3, base), (4, base + " one more word"), (5, "x" * 3_000_000), (6, base[1_200_000:])]
    got = {r.doc_id: r for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].component_id for k in (3, 4, 5, 6)] == [3, 3, 5, 6] and got[3].n_shingles == 399_996
