"""Quality rules with risk-controlled cutoffs.

Fixed base rules reject broken documents. The other rules' cutoffs are chosen with labelled holdouts: for each stratum the
strictest step of a sequence, drawn from other labelled documents, whose rate of false rejections is shown by an exact
binomial bound to be under a limit. Steps are tested in a fixed sequence, strata with a correction for their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import looked_up, stored, stored_with

#: The base rules.
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]
#: Rules: a ratio and the cutoffs that are tried; a document above a cutoff is rejected.
#: Steps, loosest first: the share of the good documents that a rule may reject where the steps are drawn, and by how many places of
#: GRID its cutoff is then raised.
STEPS = [(0.0, 4), (0.0, 3), (0.0, 2), (0.0, 1), (0.0, 0), (0.0005, 0), (0.001, 0), (0.0015, 0), (0.002, 0), (0.003, 0), (0.004, 0), (0.005, 0), (0.0075, 0), (0.01, 0), (0.015, 0), (0.02, 0)]
GRID = [0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def ratios() -> dict[str, Column]:
    return {
        "symbols": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_words": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
        "upper_case": F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
    }


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    m = len(seen)
    pair = ids[:-1] * m + ids[1:]
    if m < 2_000_000:
        window = pair[:-1] * m + ids[2:]
    else:  # three numbers don't fit one; number the pairs first
        window = np.unique(pair, return_inverse=True)[1][:-1] * m + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return int(covered.sum())


def counts(text: bytes, n_chars: int) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8 that has n_chars code points."""
    words = text.split()
    spaces = len(text) - sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols, upper = (len(text) - len(text.translate(None, x)) for x in (SYMBOLS, UPPER))
    return len(words), n_chars - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), upper, len(lines)


def measure(docs: DataFrame, stratum: str | None = None) -> DataFrame:
    """doc_id, stratum (a column as text; null: empty) and counts of every whole text. Words end at ASCII white space; null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            rows = [counts(t or b"", n) for n, t in zip(chars, batch.column(2).cast(pa.binary()).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], ["doc_id", "stratum", *COUNTS])

    own = F.col(stratum).cast("string") if stratum in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(own, F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def chance_of_at_most(k: int, n: int, p: float) -> float:
    """Probability that a binomial count of n at rate p is at most k, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i))]) + np.arange(k + 1) * math.log(p) + (n - np.arange(k + 1)) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def steps(rows: pd.DataFrame) -> pd.DataFrame:
    """stratum and cuts (a cutoff of GRID for each rule and each of STEPS) from n and over, the documents over each rule's cutoffs."""
    cuts = []
    for n, over in zip(rows["n"], rows["over"], strict=True):
        of_rule = np.asarray(over).reshape(-1, len(GRID))
        # the least cutoff with few enough rejections, raised; no ratio is over 1
        cuts.append([[([*GRID, 1.0] + [1.0] * up)[int(np.argmax(np.append(x <= math.floor(share * n), True))) + up] for share, up in STEPS] for x in of_rule])
    return pd.DataFrame({"stratum": rows["stratum"], "cuts": cuts})


def prove(rows: pd.DataFrame, risk: float, level: float) -> pd.DataFrame:
    """Strata with the cutoffs of the strictest step that is proven, from n and rejected (an array over STEPS): steps are tested from the loosest on, and the first that fails ends it."""
    out = []
    for stratum, n, rejected, cuts in zip(rows["stratum"], rows["n"], rows["rejected"], rows["cuts"], strict=True):
        proven = None
        for step, k in enumerate(rejected):
            if chance_of_at_most(int(k), int(n), risk) > level:
                break
            proven = step
        if proven is not None:
            out.append((stratum, [c[proven] for c in cuts], int(n), int(rejected[proven])))
    return pd.DataFrame(out, columns=["stratum", "cuts", "n", "rejected"])


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """The measured documents that pass the base rules and have a label of quality 1, with fold: whether a hash of the id puts them in the quarter that steps are drawn from."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return measured.where(~base_failed()).join(good, "doc_id", "left_semi").withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 4 == 0)


def learn(measured: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """stratum, cuts (a cutoff for each of ratios()), n and rejected (of the holdout) of each stratum that gets cutoffs.

    A quarter of the labelled good documents draws a sequence of steps: at a step each rule has the least cutoff of GRID that rejects no
    more than that step's share of them, or one some places above it. The other documents are the holdout. A step is proven if so few of them are rejected by any rule
    that this had a chance of at most level / strata at the rate risk; being tested in a fixed sequence, steps need no correction. So
    with probability 1 - level no stratum loses more than the share risk of its good documents to the cutoffs.
    """
    rows = stored(labelled(measured, labels).select("stratum", "fold", *(r.alias(rule) for rule, r in ratios().items())), "labelled")
    rules = list(ratios())
    over = [F.sum((F.col(rule) > c).cast("long")) for rule in rules for c in GRID]
    drawn = rows.where("fold").groupBy("stratum").agg(F.count("*").alias("n"), F.array(*over).alias("over"))

    drawn = stored(drawn.mapInPandas(lambda parts: map(steps, parts), "stratum string, cuts array<array<double>>"), "steps")
    strata = drawn.count()
    held = looked_up(rows.where("not fold"), drawn, "stratum", rows.count())
    rejected = [F.sum(F.greatest(*((F.col(rule) > F.get(F.get("cuts", F.lit(k)), F.lit(step))).cast("long") for k, rule in enumerate(rules)))) for step in range(len(STEPS))]
    tested = held.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*rejected).alias("rejected"), F.first("cuts").alias("cuts"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield prove(part, risk, level / max(1, strata))

    return stored(tested.mapInPandas(run, "stratum string, cuts array<double>, n long, rejected long"), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """Counts, base_failed, kept and the failed rules (array) for every document.

    kept: the base rules hold and no ratio is over its stratum's cutoff. With probability 1 - level, no stratum loses more
    than the share `risk` of its good documents to the cutoffs. stratum names a column of docs; null is a
    stratum of its own, and one without enough labelled documents has no cutoffs. Null text: no words, so base_failed.
    Repeated rows give repeated rows, an empty table none; no labels mean no cutoffs; further columns are not read.
    """
    measured, seen = stored_with(measure(docs, stratum), "measured", n=F.count("*"))
    found = learn(measured, labels, risk, level).select("stratum", "cuts")
    failed = [F.when(ratio > F.get("cuts", F.lit(k)), F.lit(rule)) for k, (rule, ratio) in enumerate(ratios().items())]
    met = looked_up(measured, found, "stratum", seen["n"], "left")
    out = met.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_compact(F.array(*failed))).drop("cuts")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
