import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointweave.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, dup, lines = WORD.findall(text), set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(re.findall("[A-Z]", text)), lines


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab \n\t#A"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_counts(text):
    assert qr.counts(text.encode(), len(text)) == brute(text)


def test_documents_and_odd_rows(documents, odd, none):
    for docs in (documents, odd):
        texts = {r.doc_id: r.text for r in docs.collect()}
        rows = qr.measure(docs, "lang").collect()
        assert len(rows) == docs.count() and all(tuple(r)[2:] == brute(texts[r.doc_id]) for r in rows)
    assert qr.measure(none, "lang").count() == 0


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.05), (10, 10, 0.5), (7, 200, 0.02), (0, 0, 0.1)])
def test_binomial(k, n, p):
    from math import comb

    assert qr.chance_of_at_most(k, n, p) == pytest.approx(min(1, sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))), rel=1e-9)


def test_steps_are_proven_in_sequence():
    cuts = [[0.9] * len(qr.STEPS)] * 4
    rows = pd.DataFrame({"stratum": ["en", "de", "fr"], "n": [1000, 200, 300], "rejected": [[0, 2, 9, 30, *[0] * 12], [0] * 16, [4, *[0] * 15]], "cuts": [cuts] * 3})
    got = qr.prove(rows, 0.02, 0.05 / 3)
    # 200 documents without a rejection prove nothing at 0.05 / 3; a failed step ends the sequence
    assert got["stratum"].tolist() == ["en"] and got["rejected"].tolist() == [9]
    assert qr.chance_of_at_most(9, 1000, 0.02) <= 0.05 / 3 < qr.chance_of_at_most(30, 1000, 0.02)
    assert qr.prove(rows, 0.02, 0.05)["stratum"].tolist() == ["en", "de"]


RATIO = {"symbols": lambda r: r.n_symbols / max(1, r.word_chars), "dup_lines": lambda r: r.n_dup_lines / max(1, r.n_lines), "repeat_words": lambda r: r.n_repeat_words / max(1, r.n_words), "upper_case": lambda r: r.n_upper / max(1, r.word_chars)}


def steps(rows):
    """Cutoffs (rule by step) from one stratum's rows of the drawing fold."""
    out = []
    for ratio in RATIO.values():
        over = [sum(ratio(r) > c for r in rows) for c in qr.GRID]
        grid = [*qr.GRID, *[1.0] * 9]
        out.append([grid[next((g for g, k in enumerate(over) if k <= math.floor(share * len(rows))), len(qr.GRID)) + up] for share, up in qr.STEPS])
    return out


def test_judge_against_brute_force(spark, none, odd):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = qr.judge(docs, labels).collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    own = [r for r in got if r.doc_id in good and not r.base_failed]
    drawing = lambda r: zlib.crc32(str(r.doc_id).encode()) % 4 == 0
    strata = {r.stratum for r in own if drawing(r)}
    found, held = {}, {}
    for s in strata:
        cuts = steps([r for r in own if r.stratum == s and drawing(r)])
        held[s] = [r for r in own if r.stratum == s and not drawing(r)]
        for k in range(len(qr.STEPS)):
            rejected = sum(any(f(r) > c[k] for f, c in zip(RATIO.values(), cuts)) for r in held[s])
            if qr.chance_of_at_most(rejected, len(held[s]), 0.02) > 0.05 / len(strata):
                break
            found[s] = {f: c[k] for f, c in zip(RATIO, cuts)}
    assert {"en", "fr", "de", "es"} <= set(found)
    for r in got:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        failed = [f for f in RATIO if RATIO[f](r) > found.get(r.stratum, {}).get(f, 9)]
        assert r.base_failed == base and sorted(r.failed_rules) == sorted(failed) and r.kept == (not base and not failed)
    assert all(sum(not r.kept for r in held[s]) <= 0.02 * len(held[s]) for s in found)
    assert qr.judge(none, labels).count() == 0
    assert all(r.kept == (not r.base_failed) for r in qr.judge(odd, labels.where("false")).collect())


def test_clashing_columns_and_many_strata(spark):
    rows = [(k, f"w{k} " * 60, f"lang{k}", 1, "x", None) for k in range(500)] + [(7, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, stratum string, cuts string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(500)], "doc_id long, quality int, n_words int")
    got = qr.judge(docs, labels).collect()
    assert len(got) == 501 and all(r.base_failed for r in got)


def test_very_long_text(spark):
    rows = [(0, "one two three four five " * 600_000), (1, "x" * 3_000_000), (2, " ".join(f"w{k}" for k in range(400_000)))]
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert [(got[k].n_words, got[k].n_repeat_words, got[k].kept) for k in range(3)] == [(3_000_000, 3_000_000, False), (1, 0, False), (400_000, 0, True)]
