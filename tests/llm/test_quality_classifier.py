import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pointweave.llm import quality_classifier as qc


def test_gradient_fits_ordered_grades():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(3000)]
    weights = rng.normal(size=40) * 2
    score = np.array([weights[r].sum() for r in rows]) + rng.logistic(size=3000)
    grades = np.digitize(score, [-2, 2])
    model = qc.CumulativeLink.fit(rows, grades, ridge=1e-5, rounds=300)
    assert np.all(np.diff(model.thresholds) > 0)
    assert np.corrcoef(weights[model.index], model.weights)[0, 1] > 0.98
    expected, tail = model.grades(rows)
    assert abs(tail[:, 1].mean() - (grades == 2).mean()) < 0.03 and abs(tail[:, 0].mean() - (grades >= 1).mean()) < 0.03 and np.corrcoef(expected, grades)[0, 1] > 0.7


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model_labels, held = labels.where("doc_id % 4 != 0"), {r.doc_id: r.grade for r in labels.where("doc_id % 4 = 0").select("doc_id", qc.grade().alias("grade")).collect()}
    got = {r.doc_id: r for r in qc.classify(docs.where("doc_id % 4 = 0"), model_labels.where("false")).limit(1).collect()}
    assert all(abs(r.tail_probability - 0.5) <= 0.5 for r in got.values())
    got = {r.doc_id: r for r in qc.classify(docs, model_labels).collect() if r.doc_id in held}
    good, bad = [d for d in got if held[d] == 2], [d for d in got if held[d] < 2]
    assert sum(got[d].kept for d in good) >= 0.97 * len(good) > 100
    assert sum(not got[d].kept for d in bad) >= 0.9 * len(bad) > 50


def brute_features(text):
    """Hashes of a text's features, said again: words and runs of symbols, starts of words by how many words share them, shape figures."""
    own = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", (raw := (text or "").encode()).lower())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds, n = set(own), max(1, len(own))
    upper = sum(65 <= c <= 90 for c in raw)
    symbols = sum(re.match(rb"[0-9A-Za-z\x80-\xff]", t) is None for t in own)
    shape = [10 * upper // max(1, len(raw)), 20 * symbols // n, 10 * len(kinds) // n, 10 * len(set(lines)) // max(1, len(lines)), n.bit_length()]
    names = [*kinds, *(b"\0%d:%d" % x for x in enumerate(shape))]
    for length in (5, 6, 7):
        count = Counter(t[:length] for t in kinds if len(t) > length)
        names += [mark + s for s, k in count.items() for mark, least in ((b"\1", 1), (b"\2", 2), (b"\3", 4)) if k >= least]
    return {xxhash.xxh3_64_intdigest(x) >> 40 for x in names}


def test_scores_against_brute_force(spark, odd):
    """Features, expected grade and both tail probabilities, one text at a time from the model's weights and thresholds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(odd.selectExpr("doc_id + 100000", "text"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = qc.train(docs, labels)
    weight = dict(zip(model.index.tolist(), model.weights.tolist(), strict=True))
    assert len(weight) > 10
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in qc.classify(docs, labels).collect():
        score = sum(weight.get(f, 0.0) for f in brute_features(texts[r.doc_id]))
        one, two = (1 / (1 + math.exp(t - score)) for t in model.thresholds)
        assert (r.tail_probability_1, r.tail_probability, r.expected_grade) == pytest.approx((one, two, one + two), abs=1e-5)
        assert r.tail_probability <= r.tail_probability_1


def test_screening_and_fit_against_plain_formulas():
    """Score-test values and the loss at the found weights, said again without arrays."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, 5)).astype(np.int32) for _ in range(400)]
    grades = np.array([min(2, int((r < 6).sum())) for r in rows])
    model = qc.CumulativeLink.fit(rows, grades, least=4, rounds=200, least_z=3.0)
    share = [np.mean(grades == g) for g in range(3)]
    below = [0, share[0], share[0] + share[1], 1]
    slope = [b * (1 - b) for b in below]
    pull = [(slope[g + 1] - slope[g]) / share[g] for g in range(3)]
    spread = np.mean([pull[g] ** 2 for g in grades])
    kept = [f for f in range(30) if (n := sum(f in r for r in rows)) >= 4 and abs(sum(pull[g] for r, g in zip(rows, grades) if f in r)) >= 3.0 * math.sqrt(n * spread)]
    assert model.index.tolist() == kept and set(range(6)) <= set(kept)

    def loss(weights, thresholds):
        total = 0.0
        for r, g in zip(rows, grades):
            score = sum(weights.get(int(f), 0.0) for f in r)
            edges = [0.0, *(1 / (1 + math.exp(score - t)) for t in thresholds), 1.0]
            total -= math.log(max(edges[g + 1] - edges[g], 1e-12))
        return total / len(rows) + 1e-4 * sum(w * w for w in weights.values())

    found = dict(zip(model.index.tolist(), model.weights.tolist(), strict=True))
    best = loss(found, model.thresholds)
    assert best < 0.5 * -sum(s * math.log(s) for s in share)
    for f in list(found)[:4]:
        for step in (-0.3, 0.3):
            assert loss(found | {f: found[f] + step}, model.thresholds) > best - 1e-3


def test_very_long_and_clashing(spark):
    rows = [(1, "good words " * 300_000, 1, "x"), (2, "y" * 3_000_000, None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int, features string")
    labels = spark.createDataFrame([(1, 1, 0, "g"), (2, 0, 0, "h")], "doc_id long, quality int, toxic int, grade string")
    assert qc.classify(docs, labels).count() == 3


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, None if k % 3 else 1) for k in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = qc.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 and r.kept == (r.tail_probability >= 0.5) for r in got)
    assert qc.classify(none, labels).count() == 0


def test_repeated_ids_do_not_widen_the_sample(spark):
    """A labelled id with thousands of rows counts once in the sample."""
    docs = spark.range(5000).selectExpr("id % 2 as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(bytes(r.text) for r in qc.sample(docs, labels, 12).collect()) == [b"text 0", b"text 1"]
