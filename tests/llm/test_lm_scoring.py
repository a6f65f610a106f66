import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointweave.llm import lm_scoring as lm


def brute_log_p(net, of, around):
    """log P(class | neighbours' classes), one token at a time, from the weights."""
    t, b, a, a0, w, w0 = (p.astype(float) for p in net.parts)
    h = np.tanh(b + sum(t[k][c] for k, c in enumerate(around)))
    g, k = divmod(of, lm.IN_GROUP)
    one, two = h @ a + a0, h @ w[g] + w0[g]
    return one[g] - math.log(np.exp(one).sum()) + two[k] - math.log(np.exp(two).sum())


def brute(texts, net, known, least):
    """(tokens, likelihood, new) of each text."""
    rows = [(t or "").encode().lower().split() for t in texts]
    every = Counter(w for r in rows for w in r)
    number = {w: k + 1 for k, w in enumerate(known.frequent)}
    of = lambda w: number.get(w) or int(lm.shared_class(np.array([lm.hash_of(w)], dtype=np.uint64))[0])
    tokens, kinds = Counter(), Counter()
    for w, n in every.items():
        tokens[of(w)] += n
        kinds[of(w)] += 1
    out = []
    for r in rows:
        own, total, new = Counter(r), 0.0, 0
        c = [0, 0, *map(of, r), 0, 0]
        for k, w in enumerate(r):
            total += brute_log_p(net, c[k + 2], (c[k], c[k + 1], c[k + 3], c[k + 4]))
            if w in number:
                continue
            n = every[w] if every[w] >= least else every[w] - own[w]
            if n:
                total += math.log((n - lm.DISCOUNT) / tokens[of(w)])
            else:
                new += 1
                total += math.log(lm.DISCOUNT * kinds[of(w)] / tokens[of(w)]) - (len(w) + 1) * math.log(257)
        out.append((len(r), total, new))
    return out


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()
    texts = [r.text for r in docs.collect()]
    model = lm.train(docs)
    got = lm.score(docs, model).collect()
    want = brute([r.text for r in docs.collect()], lm.Network(model.flat), model.known, lm.LEAST_COMMON)
    assert len(model.known.hashes) == 0 or model.known.n.min() >= lm.LEAST_COMMON
    ids = {r.doc_id: w for r, w in zip(docs.collect(), want, strict=True)}
    assert len(got) == len(texts)
    for r in got:
        n, total, new = ids[r.doc_id]
        assert (r.n_tokens, r.n_new) == (n, new) and r.log_likelihood == pytest.approx(total, rel=1e-4, abs=1e-3)
        assert r.pseudo_perplexity == pytest.approx(math.exp(-r.log_likelihood / n))


def test_gradient_learns_all_four_neighbours():
    """The middle token depends on the second neighbours of both sides: no narrower window could tell it."""
    rng = np.random.default_rng(0)
    near = rng.integers(1, 5, (40_000, 4))
    rows = np.column_stack([(near[:, 0] + near[:, 3]) % 4 * 40 + 1, near])
    net = lm.Network.start(np.ones(lm.CLASSES))
    square = [np.full_like(p, 1e-4) for p in net.parts]
    losses = [net.train(rows, square, 0.3) for _ in range(12)]
    assert losses[-1] < 0.3 < losses[0]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    net = lm.Network(rng.standard_normal(sum(map(math.prod, lm.Network.SHAPES))))
    around = np.repeat(rng.integers(0, lm.CLASSES, (3, 4)), lm.CLASSES, axis=0)
    rows = np.column_stack([np.tile(np.arange(lm.CLASSES), 3), around])
    assert np.allclose(np.exp(net.log_probabilities(rows).astype(float)).reshape(3, -1).sum(axis=1), 1, atol=1e-4)


def test_windows():
    rows = lm.windows(np.array([5, 6, 7, 8]), np.array([3, 0, 1]))
    assert rows.tolist() == [[5, 0, 0, 6, 7], [6, 0, 5, 7, 0], [7, 5, 6, 0, 0], [8, 0, 0, 0, 0]]


def test_training_does_not_depend_on_partitions(spark, documents):
    """Other files, partitions and tasks, and the same rows in another order: the same weights."""
    known = lm.counts(lm.word_counts(documents))
    one = lm.fit(documents, known).flat
    two = lm.fit(documents.repartition(7, "source").orderBy(F.desc("text")), known).flat
    assert np.array_equal(one, two)


def test_training_does_not_depend_on_batches(spark, documents):
    """The same weights whatever the size of the batches that reach Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        weights = []
        for size in ("10000", "7"):
            spark.conf.set(key, size)
            weights.append(lm.train(documents).flat)
    finally:
        spark.conf.set(key, before)
    assert np.array_equal(*weights)


def test_own_text_beats_its_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = lm.train(docs)
    rng = np.random.default_rng(1)
    plain = [r.text for r in docs.where(F.size(F.split("text", r"\s+")) >= 100).limit(300).collect()]
    mixed = [" ".join(rng.permutation(t.split())) for t in plain]
    both = spark.createDataFrame([(k, t) for k, t in enumerate(plain + mixed)], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in lm.score(both, model).collect()}
    assert sum(got[k] > got[300 + k] for k in range(300)) >= 250


def test_texts_that_occur_twice_have_fewer_new_words(spark):
    """Planted second copies: the words that only they have are known from the other copy."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = docs.where("doc_id % 17 = 3").selectExpr("doc_id + 100000 as doc_id", "text")
    got = {r.doc_id: r for r in lm.score(docs.union(planted)).collect()}
    once = lm.score(docs).collect()
    twice = [r for r in once if r.doc_id % 17 == 3]
    assert len(twice) > 50 and all(got[r.doc_id].n_new == got[r.doc_id + 100000].n_new == 0 for r in twice)
    assert sum(got[r.doc_id].pseudo_perplexity < r.pseudo_perplexity for r in twice if r.n_new) >= 0.95 * sum(r.n_new > 0 for r in twice)


def test_odd_rows(odd, none):
    got = lm.score(odd).collect()
    assert len(got) == odd.count() and all((r.pseudo_perplexity is None) == (r.n_tokens == 0) and math.isfinite(r.log_likelihood) for r in got)
    assert lm.score(none).count() == 0


def test_very_long_text(spark):
    rows = [(0, "a b c d " * 700_000), (1, "x" * 3_000_000), (2, "a b")]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_tokens for k in range(3)] == [2_800_000, 1, 2] and got[1].n_new == 0  # so few words that each has a class


def test_worker_forgets_words(spark, documents, monkeypatch):
    """A worker that starts its store anew scores alike."""
    model = lm.train(documents)
    words = lm.Words(model.known)
    texts = lm.split([r.text.encode() for r in documents.limit(50).collect()])
    want = [words.classes([t]).tolist() for t in texts]
    monkeypatch.setattr(lm, "CACHE", 10)
    assert [words.classes([t]).tolist() for t in texts] == want


def test_words_of():
    """The words of texts in Arrow are those of split(): any white space, nulls, bytes that are no UTF-8, a slice of a column."""
    texts = [None, b"", b" ", b"  A b\n\x0bC\x0c", b"x", b"\xc3\x89\xff Z\x1c\x00\xa0y ", b"\t\r\n", b"a  a"]
    for low, high in ((0, 8), (2, 6), (0, 0)):
        words, n = lm.words_of(pa.array(texts, pa.binary()).slice(low, high - low))
        want = lm.split(texts[low:high])
        assert words.to_pylist() == [w for x in want for w in x] and n.tolist() == [len(x) for x in want]


def test_gradient_of_all_weights():
    """One step of train() is a step of Adagrad along the gradient, found by differences of the loss."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, lm.CLASSES, (50, 5))
    start = (rng.standard_normal(sum(map(math.prod, lm.Network.SHAPES))) * 0.3).astype(np.float32)
    net = lm.Network(start.copy())
    square = [np.zeros_like(p) for p in net.parts]
    with np.errstate(divide="ignore", invalid="ignore"):
        loss = net.train(rows, square)
    assert loss == pytest.approx(-lm.Network(start).log_probabilities(rows).mean(), rel=1e-4)

    def loss_of(part, at, by):
        moved = lm.Network(start.copy())
        moved.parts = [p.astype(float) for p in moved.parts]
        moved.parts[part][at] += by
        return -np.mean([brute_log_p(moved, r[0], r[1:]) for r in rows])

    for part, s in enumerate(square):
        at = np.unravel_index(np.argmax(s), s.shape)
        slope = (loss_of(part, at, 1e-4) - loss_of(part, at, -1e-4)) / 2e-4
        assert math.sqrt(s[at]) == pytest.approx(abs(slope), rel=1e-2)
