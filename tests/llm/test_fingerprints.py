import hashlib

from pyspark.sql import functions as F

from pointweave.llm import fingerprints as fp


def brute(rows):
    """with_next over rows (doc_id, text) in order."""
    out = []
    for k, (d, t) in enumerate(rows):
        text, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(text) // 2
        edited = text[: len(text) - h] + nxt[:h]
        same = lambda a, b: float(fp.canonical(a) == fp.canonical(b))
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), same(text, edited), same(text, nxt)))
    return out


def test_documents(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = {r.doc_id: r for r in fp.with_next(documents).collect()}
    assert len(got) == len(rows)
    for d, n, sha, edited, nxt in brute(rows):
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, edited, nxt)
    by = {}
    for d, t in rows:
        assert by.setdefault(fp.canonical(t), got[d].fingerprint) == got[d].fingerprint
    assert len(set(by.values())) == len(by)


def test_odd_rows_and_one_row(spark, odd, none):
    one = odd.dropDuplicates(["doc_id"]).where("doc_id is not null")
    rows = sorted((r.doc_id, r.text) for r in one.collect())
    got = {r.doc_id: r for r in fp.with_next(one).collect()}
    assert {d: (n, sha, e, x) for d, n, sha, e, x in brute(rows)} == {d: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for d, r in got.items()}
    assert fp.with_next(odd).count() == odd.count() and fp.fingerprint(odd).count() == odd.count()
    single = fp.with_next(one.where("doc_id = 17")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    assert fp.with_next(none).count() == fp.fingerprint(none).count() == 0


def test_folding(spark):
    docs = spark.createDataFrame([(1, "Straße  ﬁn"), (2, "STRASSE\nfin "), (3, "strasse fins"), (4, None), (5, " ")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprint(docs).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5]


def test_collisions_are_parted(spark):
    docs = spark.createDataFrame([(k, f"text {k // 2}") for k in range(200)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprint(docs, bits=4).collect()}
    assert len(set(got.values())) == 100 and all(got[k] == got[k + 1] for k in range(0, 200, 2))
    both = {r.doc_id: r for r in fp.with_next(docs, bits=4).collect()}
    assert all(r.fingerprint.startswith(got[d]) for d, r in both.items())
    # among all texts, edited ones included: equal fingerprints just for equal texts
    texts = [f"text {k // 2}" for k in range(200)]
    of = {}
    for k, t in enumerate(texts):
        nxt = texts[(k + 1) % 200]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        for text, mark in ((t, both[k].fingerprint), (edited, both[k].edited_fingerprint)):
            assert of.setdefault(fp.canonical(text), mark) == mark
    assert len(set(of.values())) == len(of)


def test_many_ranges(spark, documents, monkeypatch):
    """More ranges than edges: cut evenly, also where ids lie unevenly."""
    docs = documents.select((F.col("doc_id") * F.col("doc_id") * 1000).alias("doc_id"), "text").where("doc_id < 9000000")
    want = sorted(map(tuple, fp.with_next(docs).collect()))
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 3)
    monkeypatch.setattr(fp, "EDGES", 4)
    assert fp.ranged(docs).select("range").distinct().count() > 8
    assert sorted(map(tuple, fp.with_next(docs).collect())) == want


def test_very_long_texts(spark):
    rows = [(1, "Ab " * 1_000_000), (2, "é" * 2_000_000), (3, "x")]
    got = {r.doc_id: r for r in fp.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: (n, sha, e, x) for d, n, sha, e, x in brute(rows)} == {d: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for d, r in got.items()}
