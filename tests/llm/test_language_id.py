import math
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pointweave.llm import language_id as li

PATH = public_tokenizers.path("piece_bpe_32k.model")


def vocabulary():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    every = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return sorted({p.lower() for p in every if (p == "▁" or p.removeprefix("▁").isalpha())})


def segmentations(text, index):
    """All segmentations of text into pieces (or single unknown characters), as lists of piece numbers."""
    if not text:
        yield []
    for k in range(1, min(li.pieces(PATH).longest, len(text)) + 1):
        piece = text[:k]
        if piece in index or k == 1:
            for rest in segmentations(text[k:], index):
                yield [index.get(piece, -1), *rest]


def test_forward_sums_all_segmentations():
    pieces, words = li.pieces(PATH), ["a", "the", "nation", "größe", "été", "的x", "zzzz", "internationalization"]
    index = {p: k for k, p in enumerate(vocabulary())}
    assert pieces.size == len(index)
    probs = np.random.default_rng(0).dirichlet(np.ones(pieces.size), 2).T
    probs = np.vstack([probs, [li.UNKNOWN] * 2])
    got = pieces.forward(words, probs)
    for w, row in zip(words, got, strict=True):
        for lang in range(2):
            total = sum(math.prod(probs[k, lang] for k in s) for s in segmentations("▁" + w, index))
            assert row[lang] == pytest.approx(math.log(total), abs=1e-9)


def test_expected_counts():
    pieces, words = li.pieces(PATH), ["nation", "the", "été"]
    index = {p: k for k, p in enumerate(vocabulary())}
    flat = np.full((pieces.size + 1, 1), 1 / pieces.size)
    flat[-1] = li.UNKNOWN
    got = pieces.expected(words, np.array([[1.0, 0], [0, 2], [3, 0]]), flat)
    want = np.zeros_like(got)
    for w, lang, weight in zip(words, (0, 1, 0), (1, 2, 3), strict=True):
        every = [(s, math.prod(flat[k, 0] for k in s)) for s in segmentations("▁" + w, index)]
        for s, p in every:
            for k in s:
                want[k, lang] += weight * p / sum(q for _, q in every)
    assert np.allclose(got, want)


def test_no_piece_is_left_out():
    assert li.pieces(PATH).longest > 10 and li.pieces(PATH).size == len(vocabulary())


def test_long_words(monkeypatch):
    """Words past what floats hold, in one piece: against the recursion in logarithms, and the short way where both work."""
    pieces = li.pieces(PATH)
    index = {p: k for k, p in enumerate(vocabulary())}
    probs = np.vstack([np.random.default_rng(0).dirichlet(np.ones(pieces.size), 2).T, [li.UNKNOWN] * 2])
    words = ["donaudampfschifffahrtsgesellschaft" * 9, "的" * 300, "zzzzqqqq" * 40, "a" * 500]

    def logs(text, lang):
        out = [0.0]
        for t in range(1, len(text) + 1):
            terms = [out[t - k] + math.log(probs[index.get(text[t - k : t], -1), lang]) for k in range(1, min(pieces.longest, t) + 1) if k == 1 or text[t - k : t] in index]
            out.append(max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms)))
        return out[-1]

    got = pieces.forward([*words, "nation"], probs)
    for w, row in zip([*words, "nation"], got, strict=True):
        for lang in range(2):
            assert row[lang] == pytest.approx(logs("▁" + w, lang), rel=1e-9)
    flat = np.full((pieces.size + 1, 1), 1 / pieces.size)
    flat[-1] = li.UNKNOWN
    some = ["donaudampfschifffahrtsgesellschaft", "internationalization", "的x", "nation"]
    weights = np.array([[1.0], [2], [1], [5]])
    short, ways = pieces.forward(some, probs), pieces.expected(some, weights, flat)
    monkeypatch.setattr(li, "LEAST_LOG", -1.0)
    assert np.allclose(pieces.forward(some, probs), short, rtol=1e-9) and np.allclose(pieces.expected(some, weights, flat), ways, atol=1e-9)


def test_very_long_text(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate([("the nation of words " * 150_000, "en"), ("x" * 300_000, "en"), ("die größe der wörter " * 200, "de"), ("le mot et la nation", "fr")] * 3)]
    got = li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()
    assert len(got) == 12 and all(r.lang_pred == "en" for r in got if r.doc_id % 4 == 0)


def test_too_many_languages(spark):
    rows = [(k, "some text", f"l{k}") for k in range(800)]
    with pytest.raises(ValueError):
        li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    got = li.identify(docs, PATH).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held) > 100


def test_odd_rows(odd, none):
    got = li.identify(odd, PATH).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert li.identify(none, PATH).count() == 0
    assert {r.lang_pred for r in li.identify(odd.withColumn("lang", odd.lang.substr(9, 1)).replace("", None), PATH, training=none).collect()} == {"und"}


def scorer(langs):
    pieces = li.pieces(PATH)
    probs = np.random.default_rng(1).dirichlet(np.ones(pieces.size), langs).T
    return li.Scorer(PATH, np.vstack([probs, [li.UNKNOWN] * langs]))


def test_small_blocks_give_the_same(monkeypatch):
    texts = ["the nation of words " * 20, None, "größe été " + "a" * 300, "", "die wörter", " ".join(f"w{chr(97 + k % 26)}{'x' * (k % 30)}" for k in range(400))]
    whole, n = scorer(3).texts(texts)
    for name, value in (("CACHE", 40), ("BLOCK", 12), ("LONG", 400)):
        monkeypatch.setattr(li, name, value)
    again = scorer(3)
    for _ in range(2):
        parts, m = again.texts(texts)
        assert np.allclose(parts, whole, rtol=1e-12) and list(m) == list(n) == [80, 0, 3, 0, 2, 400]
        assert len(again.score) * 3 <= 2 * 40 + 3


def test_memory_at_the_most_languages():
    """Scoring takes less than 300 MB besides the probabilities, with as many languages as there may be and many different words."""
    own = scorer(li.MOST_LANGS)
    text = " ".join("".join(chr(97 + (k // 26**j) % 26) for j in range(4)) + "tion" * (k % 9) for k in range(1_500))
    tracemalloc.start()
    out, n = own.texts([text, "y" * 3_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n[0] == 1_500 and np.isfinite(out).all() and peak < 300e6, peak
