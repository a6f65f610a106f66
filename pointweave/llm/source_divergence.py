"""Audit of how sources differ in their words: for each count a group has a bitmap of the terms with that count; the popcount of two
groups' bitmaps ANDed is how many terms have such a pair of counts, and terms that one or both lack follow by complement.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import looked_up, stored, stored_with
from pointweave.operators.ranking import ranked

#: Shares are in parts of so many; each count is raised by PRIOR first.
SCALE, PRIOR = 1_000_000_000, 5
#: Terms of a chunk (a bitmap has 64 in a word), chunks of a slab, sources of a block. A task holds two blocks' bitmaps of a chunk.
CHUNK, SLAB, BLOCK = 256, 8, 64
WORDS = CHUNK // 64
#: Terms that a task counts before it passes them on.
HELD = 300_000
#: Bytes of terms as lower case, all others as spaces: terms are letters A-Z and a-z and all that isn't ASCII.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8), n (occurrences) and docs (documents with it), in parts that are to be added; a row with null term for every group."""

    def flushed(held: dict) -> pa.RecordBatch:
        rows = [(lang, source, None, 0, 0) for lang, source in held]
        rows += [(*group, term, n, docs[term]) for group, (occurs, docs) in held.items() for term, n in occurs.items()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                occurs, docs = held[lang, source]
                own = Counter(text.translate(TERM_BYTES).split())
                size -= len(occurs)
                occurs.update(own)
                docs.update(own.keys())
                size += len(occurs)
                if size >= HELD:
                    yield flushed(held)
                    held.clear()
                    size = 0
        if held:
            yield flushed(held)

    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact; null where there are no terms."""
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(20,0)") * (n + F.lit(PRIOR)).cast("decimal(18,0)"), (total + F.lit(PRIOR) * terms).cast("decimal(19,0)"))
    return F.when(terms > 0, F.lit(1) + whole).cast("long")


def popcounts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each bitmap of a and each of b, in how many bits both are set."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(WORDS):
        out += np.bitwise_count(a[:, k, None] & b[None, :, k])
    return out


class Chunk:
    """A side's bitmaps of a chunk, in order of their group: at (place of the group), share, bits, and the set bits' number."""

    def __init__(self, at: np.ndarray, p: np.ndarray, bits: np.ndarray):
        self.at, self.p, self.bits = at, p, bits
        self.size = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    def of(self, low: int, high: int) -> Chunk:
        lo, hi = np.searchsorted(self.at, [low, high])
        return Chunk(self.at[lo:hi] - low, self.p[lo:hi], self.bits[lo:hi])

    def summed(self, x: np.ndarray, groups: int) -> np.ndarray:
        """x (whose last axis is bitmaps) summed by group."""
        out = np.zeros((*x.shape[:-1], groups), dtype=np.int64)
        there, starts = np.unique(self.at, return_index=True)
        if len(there):
            out[..., there] = np.add.reduceat(x, starts, axis=-1)
        return out


def distances(a: Chunk, zero_a: int, b: Chunk, zeros_b: np.ndarray, terms: int) -> np.ndarray:
    """Sum of the shares' differences over a chunk's terms between one group (all of a) and each group of b. zero_a, zeros_b: their shares of a term that they lack."""
    groups = len(zeros_b)
    cells = popcounts(a.bits, b.bits)
    total = b.summed((cells * np.abs(a.p[:, None] - b.p)).sum(axis=0), groups)
    met = b.summed(cells, groups)
    total += ((a.size[:, None] - met) * np.abs(a.p[:, None] - zeros_b)).sum(axis=0)  # terms that only a has
    total += b.summed((b.size - cells.sum(axis=0)) * np.abs(zero_a - b.p), groups)  # that only the other has
    neither = terms - a.size.sum() - b.summed(b.size, groups) + met.sum(axis=0)
    return total + neither * np.abs(zero_a - zeros_b)


def pair_sums(bitmaps: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b (numbers of groups of one lang, a < b) and value, in parts that are to be added.

    bitmaps: number, chunk, p and bits; groups: number, p0, terms (kept ones of the lang), low and high (the lang's first and last number).
    """
    block = F.floor(F.col("number") / BLOCK)
    others = F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))
    pair = F.transform(others, lambda c: F.struct(F.least(c, F.col("block")).alias("i"), F.greatest(c, F.col("block")).alias("j")))
    slabs = F.greatest(F.ceil(F.col("terms") / (CHUNK * SLAB)), F.lit(1))
    bits = [f"w{k}" for k in range(WORDS)]
    columns = ["low", "pair.i", "pair.j", "slab", "chunk", "number", "p", "terms", *bits]
    heads = groups.withColumn("block", block).withColumn("pair", F.explode(pair)).withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), slabs - 1)))
    heads = heads.withColumns({"chunk": F.lit(-1).cast("long"), "p": F.coalesce("p0", F.lit(0))} | {c: F.lit(0).cast("long") for c in bits}).select(columns)
    rows = bitmaps.withColumn("block", block).withColumn("pair", F.explode(pair)).withColumn("slab", F.floor(F.col("chunk") / SLAB)).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in runs(batches, 4):
            yield from totals(key, parts)

    def totals(key: tuple[int, ...], parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        _, i, j, slab = key
        _, head = next(parts)  # chunk -1
        number, zero, terms = head[:, 0], head[:, 1], int(head[0, 2])
        sides = [np.flatnonzero(number // BLOCK == k) for k in (i, j)]
        first = [int(s[0]) for s in sides]
        value = np.zeros((len(sides[0]), len(sides[1])), dtype=np.int64)
        present = 0

        def add(rows: np.ndarray, size: int) -> None:
            whole = Chunk(np.searchsorted(number, rows[:, 0]), rows[:, 1], rows[:, 3:].view(np.uint64))
            right = whole.of(first[1], first[1] + len(sides[1]))
            for a in range(len(sides[0])):
                low = a + 1 if i == j else 0
                if low < len(sides[1]):
                    value[a, low:] += distances(whole.of(first[0] + a, first[0] + a + 1), int(zero[sides[0][a]]), right.of(low, len(sides[1])), zero[sides[1][low:]], size)

        for chunk, rows in parts:
            add(rows, min(CHUNK, terms - chunk * CHUNK))
            present += min(CHUNK, terms - chunk * CHUNK)
        absent = max(0, min(terms, (slab + 1) * SLAB * CHUNK) - slab * SLAB * CHUNK) - present
        if absent:
            add(np.empty((0, 3 + WORDS), dtype=np.int64), absent)
        a, b = np.triu_indices(len(sides[0]), 1) if i == j else map(np.ravel, np.indices(value.shape))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (number[sides[0][a]], number[sides[1][b]], value[a, b])], ["a", "b", "value"])

    dealt = heads.union(rows).repartition("low", "i", "j", "slab").sortWithinPartitions("low", "i", "j", "slab", "chunk", "number")
    return dealt.mapInArrow(run, "a long, b long, value long")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], Iterator[tuple[int, np.ndarray]]]]:
    """Sorted rows of longs as (key, parts) with parts as (next column, the columns after it); the parts of a key are to be read before the next key."""

    def pieces() -> Iterator[np.ndarray]:
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)
            cuts = np.flatnonzero((rows[1:, : keys + 1] != rows[:-1, : keys + 1]).any(axis=1)) + 1
            yield from np.split(rows, cuts)

    def whole() -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        for piece in pieces():
            if held and (held[0][0, : keys + 1] != piece[0, : keys + 1]).any():
                yield np.concatenate(held)
                held = []
            held.append(piece)
        if held:
            yield np.concatenate(held)

    parts = whole()
    ahead = next(parts, None)
    while ahead is not None:
        key = ahead[0, :keys]

        def own(key: np.ndarray = key) -> Iterator[tuple[int, np.ndarray]]:
            nonlocal ahead
            while ahead is not None and (ahead[0, :keys] == key).all():
                part = ahead
                yield int(part[0, keys]), np.ascontiguousarray(part[:, keys + 1 :])
                ahead = next(parts, None)

        yield tuple(key.tolist()), own()


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` ranks the other sources of a lang by how far their words' shares are from the
    source's, part `term` the terms whose share in the source is most above that in the lang (most_terms of them).

    Columns text, lang, source; null is ''. Terms are runs of ASCII letters, A-Z as lower case, and of all characters beyond ASCII. A lang keeps the terms of at
    least least_docs of its documents. A share is 1 + floor(10^9 (n + 5) / (N + 5 V)): n occurrences of the term, N of all V kept terms, exact.

    Occurrences are counted in the tasks that read the texts, so a hot source or term costs a row a task. Kept terms are numbered by
    frequency, so that few counts meet in a chunk of them. Pairs of sources are dealt by pairs of blocks and slabs of terms; a task holds two blocks'
    bitmaps of one chunk. Empty text has no terms; its group is still there, and a lang without kept terms has value 0 for all pairs.
    Repeated rows count as often as they come. No documents give no rows; further columns are not read.
    """
    parts = counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts, of_counts = stored_with(parts, "counts", rows=F.count("*"))
    own = counts.where("term is not null").withColumn("key", F.struct("lang", "term"))
    terms = own.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("rows")).where(F.col("docs") >= least_docs)
    kept = stored(ranked(terms, [F.col("key.lang"), F.desc("total"), F.col("key.term")], "place"), "kept")
    langs = kept.groupBy(F.col("key.lang").alias("lang")).agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"), F.min("place").alias("first"))
    occurs, of_occurs = stored_with(looked_up(own, kept.select("key", "total", "place", "rows"), "key", of_counts["rows"], count="rows").drop("docs", "rows", "key"), "occurs", rows=F.count("*"))

    sums = occurs.groupBy("lang", "source").agg(F.sum("n").alias("source_total"), F.count("*").alias("rows"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["source_total", "rows", "terms", "lang_total"])
    groups = groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("source_total"), F.col("terms")))
    groups = stored(ranked(groups, [F.col("lang"), F.col("source")], "number"), "groups")
    ends = groups.groupBy("lang").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    groups = stored(groups.join(ends, "lang").withColumn("key", F.struct("lang", "source")), "groups")

    known = looked_up(occurs.withColumn("key", F.struct("lang", "source")), groups.drop("lang", "source"), "key", of_occurs["rows"], count="rows")
    known = known.withColumn("p", share(F.col("n"), F.col("source_total"), F.col("terms")))
    over = known.withColumn("value", F.col("p") - share(F.col("total"), F.col("lang_total"), F.col("terms"))).where("value > 0")
    by_value = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    named = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    top = named.withColumn("rank", by_value).where(F.col("rank") <= most_terms)

    place = F.col("place") - F.col("first")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    word = F.floor(F.pmod(place, F.lit(CHUNK)) / 64)
    bits = [F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]
    bitmaps = known.withColumn("chunk", F.floor(place / CHUNK)).groupBy("number", "chunk", "n", "low", "high", "terms").agg(F.min("p").alias("p"), *bits)
    sums = stored(pair_sums(bitmaps, groups).groupBy("a", "b").agg(F.sum("value").alias("value")), "pairs")
    both = sums.union(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("number", "lang", "source")
    pairs = both.join(names.withColumnRenamed("number", "a"), "a").join(names.select(F.col("number").alias("b"), F.col("source").alias("item")), "b")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", by_value)
    return pairs.union(top)
