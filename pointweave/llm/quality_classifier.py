"""Ordinal quality classifier: cumulative-link regression on graded ratings with hashed text features.

All grades share one weight for each hashed token; ordered thresholds part the grades. A text gets its expected grade and
the probability of each grade or a better one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import slices

#: Hashed token space.
BITS = 24
#: Token hashes a worker keeps; then it starts anew.
CACHE = 400_000
GRADES = 3
#: Lengths of words' starts, in bytes, and steps of how many different words of a text share one.
STARTS = (5, 6, 7)
STEPS = ((b"\x01", 1), (b"\x02", 2), (b"\x03", 4))
#: Score-test value from which on a feature is used: with ten millions of features hardly one gets there by chance.
LEAST_Z = 6.0
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")


class TokenHashes(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[token] = x = xxhash.xxh3_64_intdigest(token) >> (64 - BITS)
        return x


TOKEN_HASHES = TokenHashes()


def features(text: bytes | None) -> np.ndarray:
    """Distinct hashed features of a whole text: its words (any case), runs of symbols, starts of words with steps of how many
    different words have them, and steps of five shape figures."""
    text = text or b""
    tokens = _TOKEN.findall(text.lower())
    get = TOKEN_HASHES.__getitem__
    kinds = set(tokens)
    n = max(1, len(tokens))
    upper = len(text) - len(text.translate(None, bytes(range(65, 91))))
    symbols = sum(not (t[:1].isalnum() or t[0] >= 128) for t in tokens)
    lines = [x for x in text.split(b"\n") if x.strip()]
    steps = (int(10 * upper / max(1, len(text))), int(20 * symbols / n), int(10 * len(kinds) / n), int(10 * len(set(lines)) / max(1, len(lines))), n.bit_length())
    own = {get(t) for t in kinds}
    own.update(get(b"\0%d:%d" % x) for x in enumerate(steps))
    for length in STARTS:
        for start, n in Counter([t[:length] for t in kinds if len(t) > length]).items():
            own.update(get(mark + start) for mark, least in STEPS if n >= least)
    return np.fromiter(own, dtype=np.int32, count=len(own))


def grade() -> Column:
    """Grade of a labelled document: 0 of low quality, 1 of good quality but toxic, 2 good; null without a quality label."""
    return F.when(F.col("quality") == 0, F.lit(0)).when((F.col("quality") == 1) & (F.col("toxic") == 1), F.lit(1)).when(F.col("quality") == 1, F.lit(2))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """P(grade <= k) = sigmoid(threshold_k - sum of the weights of a text's features)."""

    def __init__(self, index: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.index, self.weights, self.thresholds = index, weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, least: int = 4, rounds: int = 150, rate: float = 0.15, ridge: float = 2e-4, least_z: float = LEAST_Z) -> CumulativeLink:
        """By Adam on the mean log-loss with a ridge. Features in fewer than `least` rows, and those whose score test (of no
        weight at all) stays under least_z, have no weight: rare words are not learned by heart."""
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        index, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        often = count >= least
        if len(rows):
            share = np.bincount(grades, minlength=GRADES) / len(rows)
            below = np.concatenate([[0.0], np.cumsum(share)])
            slope = below * (1 - below)
            pull = (slope[grades + 1] - slope[grades]) / share[grades]
            hits = np.bincount(inverse, np.repeat(pull, [len(r) for r in rows]), minlength=len(index))
            often &= np.abs(hits) >= least_z * np.sqrt(count * max(float((pull**2).mean()), 1e-12))
        number = np.cumsum(often) - 1
        keep = often[inverse]
        column = number[inverse][keep]
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[keep]
        n, m = len(rows), int(often.sum())
        # thresholds: the first, and then steps that stay positive as exponentials
        share = np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / max(1, n) if n else np.full(GRADES - 1, 0.5)
        first = np.log((share + 1e-3) / (1 - share + 1e-3))
        x = np.concatenate([np.zeros(m), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
        mean, square = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, rounds + 1 if n else 1):
            w = x[:m]
            t = x[m] + np.concatenate([[0.0], np.cumsum(np.exp(x[m + 1 :]))])
            score = np.bincount(row, w[column], minlength=n)
            below = np.column_stack([np.zeros(n), sigmoid(t[None, :] - score[:, None]), np.ones(n)])
            slope = below * (1 - below)
            hit = np.arange(n)
            p = np.maximum(below[hit, grades + 1] - below[hit, grades], 1e-12)
            by_score = (slope[hit, grades + 1] - slope[hit, grades]) / p / n  # derivative of the loss by the score
            by_t = np.zeros(GRADES - 1)
            for k in range(GRADES - 1):
                by_t[k] = -(slope[grades == k, k + 1] / p[grades == k]).sum() / n + (slope[grades == k + 1, k + 1] / p[grades == k + 1]).sum() / n
            g = np.concatenate([np.bincount(column, by_score[row], minlength=m) + ridge * w, [by_t.sum()], np.cumsum(by_t[::-1])[::-1][1:] * np.exp(x[m + 1 :])])
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            x = x - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        return cls(index[often], x[:m].astype(np.float32), x[m] + np.concatenate([[0.0], np.cumsum(np.exp(x[m + 1 :]))]))

    def grades(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probabilities (columns) of at least each grade from 1 on."""
        flat = np.concatenate(rows)
        at = np.minimum(np.searchsorted(self.index, flat), max(0, len(self.index) - 1))
        w = np.where(self.index[at] == flat, self.weights[at], 0) if len(self.index) else np.zeros(len(flat))
        score = np.add.reduceat(w, np.cumsum([0, *(len(r) for r in rows[:-1])]))
        above = 1 - sigmoid(self.thresholds[None, :] - score[:, None])
        return above.sum(axis=1), above


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts and grades of at most `most` labelled documents, those first by a hash of the id; a document's worst grade counts, and of an id with several texts the least."""
    graded = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade()).alias("grade")).where("grade is not null")
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade")).select("text", "grade")


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> CumulativeLink:
    """Fit on at most `most` labelled documents (a documented bound: ids are broadcast, hashed features come to the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1)], ["features", "grade"])

    rows = sample(docs, labels, most).mapInArrow(run, "features binary, grade int").collect()
    return CumulativeLink.fit([np.frombuffer(r.features, dtype=np.int32) for r in rows], np.array([r.grade for r in rows], dtype=np.int64))


def classify(docs: DataFrame, labels: DataFrame, most: int = 12_000, least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_probability_1 (of a grade of at least 1), tail_probability (of grade 2) and kept (the latter is at least least_tail) of every whole text.

    Labels: doc_id, quality, toxic (null toxic counts as not toxic; without a quality label a row is not used). Null or empty
    text is judged by its shape alone. Without labels all thresholds lie at even odds. Repeated rows give repeated rows,
    an empty table none; further columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))  # bounded by `most` texts' features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                expected, tail = model.value.grades([features(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(expected, pa.float64()), *(pa.array(np.ascontiguousarray(x), pa.float64()) for x in tail.T), pa.array(tail[:, -1] >= least_tail)], ["doc_id", "expected_grade", "tail_probability_1", "tail_probability", "kept"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, expected_grade double, tail_probability_1 double, tail_probability double, kept boolean")
