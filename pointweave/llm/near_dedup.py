"""Near-duplicate groups: minima of many universal hashes, banding, signature verification, exact confirmation on full
shingle sets, and connected components by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import looked_up, slices, stored, stored_with
from pointweave.operators.components import connected as components

WORDS = 5
#: Rows a block has at most in mean; a task compares two blocks at a time.
BLOCK = 192
#: Bits of the filter that picks candidates' texts before they are shuffled: broadcast as at most so many / 64 rows of two longs (16 MB), whatever the input.
#: The fuller it is the more other texts pass; the join behind it is exact.
FILTER_BITS = 2**26
#: Word hashes a worker keeps; then it starts anew.
CACHE = 400_000
_UPPER = bytes(range(65, 91))
_LOWER_CASE = bytes.maketrans(_UPPER, _UPPER.lower())


@lru_cache(maxsize=4)
def universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of n multiply-shift hashes."""
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


WORD_HASHES = WordHashes()


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending. A-Z count as lower case; words end at ASCII white space."""
    own = (text or b"").translate(_LOWER_CASE).split()
    if not own:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(WORD_HASHES.__getitem__, own), dtype=np.uint64, count=len(own))
    if len(h) < words:  # the whole sequence is the one shingle, and differs from all longer ones
        total = np.array([len(h)], dtype=np.uint64)
        for k in range(len(h)):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + 1])
        return total
    m = len(h) - words + 1
    total = np.zeros(m, dtype=np.uint64)
    for k in range(words):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    return np.unique(total)


def set_hash(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """For each set, which isn't empty, the minimum under each hash."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    a, b = universal(hashes)
    out = np.empty((len(sets), hashes), dtype=np.uint32)
    for k in range(hashes):
        out[:, k] = np.minimum.reduceat(((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketches(docs: DataFrame, hashes: int, rows: int, words: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (equal for equal sets) and the band keys of each document; none for empty sets."""
    bands = hashes // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, _ = universal(hashes)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                sets = [shingles(t, words) for t in texts[lo:hi]]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                some = [s for s in sets if len(s)]
                keys = np.empty((0, bands), dtype=np.uint64)
                if some:
                    low = minima(some, hashes).astype(np.uint64).reshape(len(some), bands, rows)
                    keys = np.arange(bands, dtype=np.uint64)[None, :].repeat(len(some), 0)
                    for k in range(rows):
                        keys = mixed(keys * factor[k] + low[:, :, k])
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(map(set_hash, sets), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))],
                    ["doc_id", "n_shingles", "set_hash", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


class Forest:
    """Union-find over a task's documents."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def links(sets: list[np.ndarray], signatures: np.ndarray, left: np.ndarray, percent: int, slack: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between documents of a task.

    Pairs whose signatures agree less than percent minus slack are passed over; the others are confirmed on their full
    sets, in order of agreement, unless they are tied already. left marks the first block's documents: with both kinds there,
    only pairs across are looked at.
    """
    n, forest, found = len(sets), Forest(len(sets)), []
    size = np.array([len(s) for s in sets])
    across = bool(left.any() and not left.all())
    for i in range(n):
        if across and not left[i]:
            continue
        others = np.flatnonzero(~left) if across else np.arange(i + 1, n)
        lo, hi = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        others = others[100 * lo >= percent * hi]
        if not len(others):
            continue
        agree = (signatures[others] == signatures[i]).mean(axis=1)
        for k in np.argsort(-agree, kind="stable"):
            if agree[k] < percent / 100 - slack:
                break
            j = int(others[k])
            if forest.root(i) == forest.root(j):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                forest.join(i, j)
                found.append((i, j))
    return found


def picked(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """head and text of the documents of groups, and of others whose ids fall on the same bits; each different text of an id once."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at(c), F.lit(64)).cast("int"))
    word = lambda c: F.floor(at(c) / 64).alias("word")
    marked = groups.select(word("head"), bit("head").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("head"), F.col("text").cast("binary").alias("text"))
    there = texts.withColumn("word", word("head")).join(F.broadcast(marked), "word").where(F.col("bits").bitwiseAND(bit("head")) != 0)
    return there.select("head", "text").distinct()  # a document's repeated rows are a row a task


def confirmed(groups: DataFrame, docs: DataFrame, percent: int, hashes: int, words: int, slack: float) -> DataFrame:
    """Links (a, b: set hashes) inside candidate groups (columns set_hash, head: the document that stands for it, group, n: its number of classes), enough for the components."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("set_hash"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    # by shuffle at every size: what is small enough to broadcast in a test isn't at scale
    members = groups.withColumn("block", block).join(picked(docs, groups).hint("merge"), "head").withColumn("pair", F.explode(pair))
    dealt = members.select("group", "pair.i", "pair.j", (F.col("block") == F.col("pair.i")).alias("left"), "set_hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        out: list[tuple[bytes, bytes]] = []

        def close() -> None:
            if len(held) > 1:
                own, left = list(held), np.array([x for _, x in held.values()])
                sets = [s for s, _ in held.values()]
                out.extend((own[i], own[j]) for i, j in links(sets, minima(sets, hashes), left, percent, slack))

        for batch in batches:
            for *now, left, own, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if now != key:
                    close()
                    key, held = now, {}
                if own not in held:  # repeated rows of an id may have other texts, which are other classes
                    s = shingles(text, words)
                    if set_hash(s) == own:
                        held[own] = (s, left)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])

    return dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 80, rows: int = 5, bands: int = 40, words: int = WORDS, slack: float = 0.2) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id linked with it) and kept (it is that document) for every document.

    Two documents are linked if 100 times their shared shingles is at least percent times all their shingles. Equal sets are
    one class first. Classes that agree in all rows of a band are candidates; the candidates' components are split into
    blocks, and each task compares two blocks: by signature, then on the full sets, so no group is in one task and no list of all
    pairs is made. A pair at the limit shares no band with probability (1 - (percent/100)^rows)^bands: 1e-7 by default. Classes and bands with very
    many rows meet what belongs to them by broadcast.

    Null, empty or blank text: no shingles, linked with nothing. Fewer than `words` words: the sequence is the one shingle.
    Repeated rows of a doc_id give repeated rows, each linked by its own text; a row with null doc_id is linked with
    nothing, has null component_id and is kept. An empty table gives no rows; further columns are not read.
    """
    hashes = rows * bands
    drawn, seen = stored_with(sketches(docs, hashes, rows, words), "sketches", n=F.count("*"))
    # one document stands for all with its set, which have the same bands; a hot set is a row a task before the shuffle
    classes = drawn.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("head"), F.any_value("bands").alias("bands"))
    heads, of_heads = stored_with(classes, "classes", n=F.count("*"))
    # candidates go by 64 bits of their set hash: classes that share them are candidates together, which the full sets then settle
    short = F.xxhash64("set_hash").alias("short")
    keys = heads.select(short, F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("short").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    near = looked_up(keys, shared, "band", bands * of_heads["n"], count="n").where("short != pivot").select(F.col("short").alias("a"), F.col("pivot").alias("b"))
    groups = components(near).withColumnRenamed("node", "short").withColumnRenamed("component", "group")
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    grouped = looked_up(groups, sizes, "group", of_heads["n"], count="n").join(heads.select("set_hash", "head", short), "short").drop("short")
    found = confirmed(stored(grouped, "groups"), docs, percent, hashes, words, slack)
    tied = heads.join(components(found).withColumnRenamed("node", "set_hash"), "set_hash", "left").select("set_hash", "head", F.coalesce("component", "set_hash").alias("part"))
    tied = stored(tied, "tied")
    least = tied.groupBy("part").agg(F.min("head").alias("component"), F.count("*").alias("n"))
    named = stored(looked_up(tied, least, "part", of_heads["n"], count="n").select("set_hash", "component"), "named")
    own = drawn.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_hash")).alias("set_hash"))
    known = looked_up(own, named, "set_hash", seen["n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return known.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
