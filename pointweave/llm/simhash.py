"""Near-duplicates by SimHash: fingerprints whose bits few enough differ are linked. They are compared bit-sliced: a word holds one bit
of 64 fingerprints, carry-save counters add up 64 distances at a time, and a word's comparison is given up once all exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.common import looked_up, slices, stored, stored_with
from pointweave.operators.components import connected

#: Words of a shingle, the hash's seed, bits of a fingerprint.
WORDS, SEED, BITS = 4, 42, 64
#: Fingerprints of a block in mean; a task compares two blocks at a time. Where more share a key's bits, further bits are added to the key, so many levels of them in all.
MOST, LEVELS = 2_048, 2
#: Words of 64 fingerprints that are compared at a time.
BLOCKS = 40_000
#: After so many planes those words are given up in which all distances exceed the radius.
STEP = 8
ALL = np.uint64(2**64 - 1)
_LOWER_CASE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """XXH64 of a text's shingles, with repeats. A-Z count as lower case; words end at ASCII white space."""
    own = (text or b"").translate(_LOWER_CASE).split()
    whole, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= WORDS:
        return np.array([digest(whole, SEED)] if own else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[: -WORDS] + 1])
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends[WORDS - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit that is set in over half the hashes; 0 for none."""
    votes = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        votes += bits_of(hashes[k : k + 65_536]).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def bits_of(x: np.ndarray) -> np.ndarray:
    """A row of bits for each 64-bit number, highest first."""
    return np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, BITS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                fps = np.fromiter((fingerprint(shingle_hashes(t)) for t in texts[lo:hi]), dtype=np.uint64, count=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def exceed(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """The lanes whose distance, which counters (ones, twos, fours) and over (eight or more) hold, is over the radius."""
    same, more = ~over, over.copy()
    for k in (2, 1, 0):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def near_pairs(fps: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that differ in at most radius bits: of one from run left[k] with one from run right[k], for every k; of two from a run
    where both are the same. starts: where each run of fps begins."""
    sizes = np.diff(np.append(starts, len(fps)))
    words = -(-sizes // 64)  # each run begins a word
    first = np.cumsum(words) - words
    run = np.repeat(np.arange(len(starts)), sizes)
    slot = first[run] * 64 + np.arange(len(fps)) - starts[run]
    at = np.full(int(words.sum()) * 64, -1)
    at[slot] = np.arange(len(fps))
    bits = bits_of(fps).T
    lanes = np.zeros((BITS, len(at)), dtype=np.uint8)
    lanes[:, slot] = bits
    planes = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)
    filled = np.packbits(at >= 0, bitorder="little").view(np.uint64)
    turn = np.where(bits == 1, ALL, np.uint64(0))
    # each fingerprint of a left run meets the words of the right one; in the same run its own word and those after it, and of its own only later lanes
    meet = np.repeat(np.arange(len(left)), sizes[left])
    place = np.arange(len(meet)) - np.repeat(np.cumsum(sizes[left]) - sizes[left], sizes[left])
    own = np.where(left == right, 1, 0)[meet]
    count = words[right[meet]] - own * (place // 64)
    asks = starts[left[meet]] + place
    ask = np.repeat(asks, count)
    word = np.arange(len(ask)) - np.repeat(np.cumsum(count) - count - first[right[meet]] - own * (place // 64), count)
    wanted = filled[word]
    later = ~((np.uint64(2) << (place % 64).astype(np.uint64)) - np.uint64(1))
    wanted &= np.where(word == slot[ask] // 64, np.repeat(later, count), ALL)
    counters, over = [np.zeros(len(ask), dtype=np.uint64) for _ in range(3)], np.zeros(len(ask), dtype=np.uint64)
    for k in range(0, BITS, 2):
        x, y = planes[k][word] ^ turn[k][ask], planes[k + 1][word] ^ turn[k + 1][ask]
        half = counters[0] ^ x
        carry = counters[0] & x | half & y  # a carry-save adder takes two planes into the ones
        counters[0] = half ^ y
        for c in (1, 2):
            carry, counters[c] = counters[c] & carry, counters[c] ^ carry
        over |= carry
        if (k + 2) % STEP == 0:
            wanted &= ~exceed(counters, over, radius)
            live = np.flatnonzero(wanted)
            if len(live) < len(ask):
                ask, word, wanted, over = ask[live], word[live], wanted[live], over[live]
                counters = [c[live] for c in counters]
    block, lane = np.nonzero(np.unpackbits(wanted.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return ask[block], at[word[block] * 64 + lane]


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that edges a-b tie it to."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def compared(groups: DataFrame, radius: int) -> DataFrame:
    """Links (a, b), enough for the components, between the fingerprints fp of groups that share mask and value; n: how many these are.

    A group of over MOST is dealt in blocks: a task compares two of them, or one with itself."""
    blocks = F.ceil(F.col("n") / MOST)
    block = F.pmod(F.xxhash64("fp"), blocks)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = groups.withColumn("block", block).withColumn("pair", F.explode(pair)).select("mask", "value", "pair.i", "pair.j", (F.col("block") != F.col("pair.i")).cast("long").alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def closed() -> Iterator[pa.RecordBatch]:
            runs = [r for meet in held for r in meet]
            fps = np.concatenate(runs).view(np.uint64)
            ends = np.cumsum([len(meet) for meet in held])
            pairs = near_pairs(fps, np.cumsum([0, *map(len, runs[:-1])]), ends - [len(meet) for meet in held], ends - 1, radius)
            label = least_reached(len(fps), *pairs)
            moved = np.flatnonzero(label != np.arange(len(fps)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[label[moved]].view(np.int64))], ["a", "b"])
            held.clear()

        size = 0
        for meet in meets(batches):
            held.append(meet)
            size += len(meet[0]) * -(-len(meet[-1]) // 64)
            if size >= BLOCKS:
                yield from closed()
                size = 0
        if held:
            yield from closed()

    keys = ["mask", "value", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "a long, b long")


def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The fingerprints of each key (all columns but the last two), by side; a key with a block that meets none has no row."""
    key, sides = None, ([], [])

    def whole() -> list[np.ndarray]:
        return [np.concatenate(s) for s in sides if s]

    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi > lo:
                now = tuple(c[lo] for c in columns[:-2])
                if now != key:
                    if key is not None and (key[-2] == key[-1] or all(sides)):
                        yield whole()
                    key, sides = now, ([], [])
                sides[columns[-2][lo]].append(columns[-1][lo:hi])
    if key is not None and (key[-2] == key[-1] or all(sides)):
        yield whole()


def parted(mask: int, parts: int) -> list[int]:
    """mask with each of so many parts of the other bits added."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    return [mask | sum(1 << k for k in free[len(free) * p // parts : len(free) * (p + 1) // parts]) for p in range(parts)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def masks(spark: SparkSession, known: list[int], radius: int) -> DataFrame:
    """mask and finer of known masks: two fingerprints that agree on mask and differ in radius bits agree on one of its finer ones, too."""
    rows = [(m, signed(x)) for m in known for x in parted(m % 2**64, radius + 1)]
    return spark.createDataFrame(rows, "mask long, finer long")


def links(classes: DataFrame, n: int, radius: int) -> DataFrame:
    """Links (a, b) between n different fingerprints fp, enough for the components.

    Bits are parted into radius + 1 parts, on one of which near fingerprints agree; those who share a part are compared. Where over MOST do, the
    other bits are parted once more (LEVELS); groups that are still larger are compared block by block. No pair is lost.
    """
    spark = classes.sparkSession
    rows, known, total, out = classes.select("fp", F.lit(0).cast("long").alias("mask")), [0], n, None
    for level in range(LEVELS):
        finer = F.broadcast(masks(spark, known, radius))  # radius + 1 rows for each
        keys = rows.join(finer, "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("value"))
        keys = stored(keys.withColumn("key", F.struct("mask", "value")), "keys")
        sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        shared = looked_up(keys, sizes, "key", total * (radius + 1), count="n").drop("key")
        shared, seen = stored_with(shared, "shared", hot=F.count_if(F.col("n") > MOST))
        last = level == LEVELS - 1
        found = compared(shared if last else shared.where(F.col("n") <= MOST), radius)
        out = found if out is None else out.union(found)
        rows, total = shared.where(F.col("n") > MOST).select("fp", "mask"), seen["hot"]
        if last or not total:
            break
        known = [r.mask for r in rows.select("mask").distinct().collect()]  # at most radius + 1 times as many as before
    return out


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id linked with it) for every row.

    A bit of the fingerprint is 1 if it is set in over half the XXH64 of the text's four-word shingles, repeats included. Fingerprints that differ in at
    most radius bits (0 to 7) are linked; all such pairs count, none is left to chance. Equal fingerprints are one class first.

    Null, empty or blank text: fingerprint zero, linked like any other. Fewer than four words: the sequence is the one shingle. Repeated rows of
    a doc_id give repeated rows, each linked by its own text; a row with null doc_id is linked, too, but no component is named after it (component_id is null
    where no other row is linked). An empty table gives no rows; further columns are not read.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    drawn, seen = stored_with(fingerprints(docs), "fingerprints", n=F.count("*"))
    classes, of_classes = stored_with(drawn.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "classes", n=F.count("*"))
    tied = connected(links(classes, of_classes["n"], radius)).withColumnRenamed("node", "fp")
    tied = stored(classes.join(tied, "fp", "left").select("fp", "head", "n", F.coalesce("component", "fp").alias("part")), "tied")
    least = tied.groupBy("part").agg(F.min("head").alias("component_id"), F.count("*").alias("rows"))
    named = stored(looked_up(tied, least, "part", of_classes["n"], count="rows").select("fp", "n", "component_id"), "named")
    known = looked_up(drawn, named, "fp", seen["n"], count="n")
    return known.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
