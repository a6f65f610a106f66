import random
import re
from collections import Counter

import numpy as np
import pytest

from pointweave import shared
from pointweave.llm import source_divergence as sd

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least_docs, most_terms):
    """From the rule, term by term. rows: (text, lang, source)."""
    groups, docs = {}, {}
    for text, lang, source in rows:
        own = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        groups.setdefault((lang or "", source or ""), Counter()).update(own)
        docs.setdefault(lang or "", Counter()).update(own.keys())
    kept = {lang: {t for t, n in d.items() if n >= least_docs} for lang, d in docs.items()}
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    p = {}
    for (lang, source), own in groups.items():
        total = sum(own[t] for t in kept[lang])
        p[lang, source] = {t: share(own[t], total, len(kept[lang])) for t in kept[lang]}
    out = []
    for lang, terms in kept.items():
        whole = sum((own for (x, _), own in groups.items() if x == lang), Counter())
        total = sum(whole[t] for t in terms)
        q = {t: share(whole[t], total, len(terms)) for t in terms}
        own = [s for x, s in groups if x == lang]
        for s in own:
            pairs = sorted((-sum(abs(p[lang, s][t] - p[lang, r][t]) for t in terms), r.encode(), r) for r in own if r != s)
            out += [(lang, s, "pair", r, -v, k + 1) for k, (v, _, r) in enumerate(pairs)]
            over = sorted((q[t] - p[lang, s][t], t.encode(), t) for t in terms if groups[lang, s][t] and p[lang, s][t] > q[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(over[:most_terms])]
    return sorted(out)


def audited(spark, rows, **options):
    docs = spark.createDataFrame(rows, "text string, lang string, source string, term string, n long, p long, number long, `key` string")
    return sorted(map(tuple, sd.audit(docs, **options).collect()))


def some_rows(seed, n=300, vocabulary=900, sources=7):
    """Texts whose words are drawn with falling frequency; a source has a third of the rows."""
    rng = random.Random(seed)
    word = lambda: f"{'Wört' if rng.random() < 0.5 else 'wört'}{''.join('abcdefghij'[int(c)] for c in str(int(vocabulary * rng.random() ** 3)))}"
    draw = lambda: " ".join(word() for _ in range(rng.randrange(0, 120)))
    return [(draw(), rng.choice(["en", "de"]), rng.choice(["hot"] * 3 + [f"s{k}" for k in range(sources)])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "chunks"), [(0, None), (1, 1)])
def test_against_brute_force(spark, monkeypatch, seed, chunks):
    """Some hundred kept terms, so that several chunks are full; with slabs of a chunk and blocks of two sources; all keys hot."""
    if chunks:
        monkeypatch.setattr(sd, "SLAB", chunks)
        monkeypatch.setattr(sd, "BLOCK", 2)
        monkeypatch.setattr(sd, "HELD", 500)
        monkeypatch.setattr(shared, "FEW_ROWS", 0)
        monkeypatch.setattr(shared, "LEAST_HOT", 3)
    rows = some_rows(seed)
    want = brute(rows, 5, 20)
    assert len({r[3] for r in want if r[2] == "term"}) > 50
    assert audited(spark, [(*r, None, 1, 2, 3, "k") for r in rows], least_docs=5, most_terms=20) == want


def test_odd_rows(spark):
    long = "endless Words " * 200_000
    rows = [(None, None, None), ("", "", "x"), (None, "xx", "only"), ("a\x00b C", "xx", None), ("abc ABC aBc é É ß 12_x", "yy", "s1"), ("abc é", "yy", "s2"), ("　 的 a", "yy", "s2"), (long, "yy", "s3"), (long, "yy", "s3"), ("[]{} 123", "zz", "s1"), ("abc", "zz", "s2")]
    rows += rows[4:6]
    every = [(*r, "t", 1, 2, 3, "k") for r in rows]
    for least in (1, 2, 100):
        assert audited(spark, every, least_docs=least) == brute(rows, least, 50)
    assert audited(spark, []) == []


def test_ties_go_by_bytes(spark):
    rows = [(w, "en", s) for w in ("zebra", "Apple", "éclair", "ﬁne", "\U0001f600x") for s in "abc" for _ in range(3)] + [("zebra éclair ﬁne \U0001f600x apple", "en", "d")] * 2
    assert audited(spark, [(*r, "t", 1, 2, 3, "k") for r in rows], least_docs=2, most_terms=3) == brute(rows, 2, 3)


def test_popcounts():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**64, (5, sd.WORDS), dtype=np.uint64) for _ in range(2))
    assert sd.popcounts(a, b).tolist() == [[sum((int(x) & int(y)).bit_count() for x, y in zip(r, s, strict=True)) for s in b] for r in a]


def test_shares_beyond_longs(spark):
    """10^9 times a count may not fit 64 bits; the share does."""
    row = spark.createDataFrame([(5 * 10**12, 7 * 10**12, 11)], "n long, total long, terms long").select(sd.share(*(sd.F.col(c) for c in ("n", "total", "terms"))).alias("p")).first()
    assert row.p == 1 + 10**9 * (5 * 10**12 + 5) // (7 * 10**12 + 55)
