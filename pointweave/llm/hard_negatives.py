"""Hard negatives: exact integer inner products of anchors and candidates by Strassen's recursion on tiles of int64, and
heaps of the best positives and of the best negatives inside each positive's window, which merge across tiles and tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import stored, stored_with

#: Anchors that a task holds, and candidates that it meets, in mean; both are dealt by hash.
BLOCK, STRIPE = 4_096, 4_096
#: Rows of a tile on either side, and the size at which the recursion multiplies directly.
TILE, LEAF = 1_024, 8
#: No score: less than any.
NONE = np.iinfo(np.int64).min
#: Scores under this can be sorted together with their place in the tile.
NARROW = 2**52
#: The columns that tasks return.
NAMES = ["row", "slot", "id", "score"]


def padded(m: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return np.pad(m, ((0, rows - m.shape[0]), (0, columns - m.shape[1])))


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b in int64. Sums wrap around 2**64, so results that fit are exact whatever the sums on the way. Odd sizes are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        up = lambda x: x + x % 2
        return strassen(padded(a, up(m), up(k)), padded(b, up(k), up(n)))[:m, :n]
    (a11, a12), (a21, a22) = (np.hsplit(x, 2) for x in np.vsplit(a, 2))
    (b11, b12), (b21, b22) = (np.hsplit(x, 2) for x in np.vsplit(b, 2))
    p1, p2, p3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    p4, p5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    p6, p7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])


def descending(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's scores, greatest first, and their places; equal scores in order of place. NONE comes last."""
    width = scores.shape[1]
    real = scores != NONE
    if np.abs(np.where(real, scores, 0)).max(initial=0) < NARROW:
        at = np.sort(np.where(real, -scores * width + np.arange(width), np.iinfo(np.int64).max), axis=1)
        there = at != np.iinfo(np.int64).max
        return np.where(there, -(at // width), NONE), np.where(there, at % width, 0)
    place = np.argsort(~scores, axis=1, kind="stable")
    return np.take_along_axis(scores, place, axis=1), place


class Heaps:
    """For each of some rows the k best (score, id): higher scores first, ties by the lesser id."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), NONE), np.zeros((rows, k), dtype=np.int64)

    def merge(self, at: slice, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.hstack([self.score[at], score]), np.hstack([self.id[at], ids])
        best = np.lexsort((ids, ~score), axis=1)[:, : self.score.shape[1]]
        self.score[at], self.id[at] = np.take_along_axis(score, best, axis=1), np.take_along_axis(ids, best, axis=1)


class Tile:
    """Rows of a task as arrays: id, label, vectors (shorter ones padded with zeros) and, of anchors, row number and positives' scores."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        own = lambda name: np.asarray(table[name].to_numpy(), dtype=np.int64)
        self.row, self.id, self.label = own("row"), own("vec_id"), own("label")
        self.v, _ = self.filled(table["v"])
        self.positive, self.positives = self.filled(table["positives"])

    @staticmethod
    def filled(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """A list column as a matrix padded with zeros, and the lists' lengths."""
        lists = column.combine_chunks()
        n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        out = np.zeros((len(n), max(1, int(n.max(initial=0)))), dtype=np.int64)
        out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out, n

    def scores(self, at: slice, other: Tile) -> np.ndarray:
        width = max(self.v.shape[1], other.v.shape[1])
        return strassen(padded(self.v[at], len(self.v[at]), width), padded(other.v, len(other.v), width).T)


class Positives:
    """The best rows of the anchor's own label."""

    def __init__(self, anchors: Tile, k: int):
        self.anchors, self.heaps = anchors, Heaps(len(anchors.id), k)

    def meet(self, at: slice, scores: np.ndarray, tile: Tile) -> None:
        own = (self.anchors.label[at, None] == tile.label) & (self.anchors.id[at, None] != tile.id)
        best, place = descending(np.where(own, scores, NONE))
        k = self.heaps.score.shape[1]
        self.heaps.merge(at, best[:, :k], tile.id[place[:, :k]])

    def found(self) -> list[np.ndarray]:
        row, slot = np.nonzero(self.heaps.score != NONE)
        return [self.anchors.row[row], np.zeros_like(slot), self.heaps.id[row, slot], self.heaps.score[row, slot]]


class Negatives:
    """For each positive of an anchor the best rows of other labels whose score is from low to high per cent of the positive's."""

    def __init__(self, anchors: Tile, k: int, low: int, high: int):
        self.anchors, self.k = anchors, k
        whole, rest = anchors.positive // 100, anchors.positive % 100  # so that no product overflows
        self.least, self.most = whole * low - (-rest * low // 100), whole * high + rest * high // 100
        self.heaps = [Heaps(len(anchors.id), k) for _ in range(anchors.positive.shape[1])]

    def meet(self, at: slice, scores: np.ndarray, tile: Tile) -> None:
        best, place = descending(np.where(self.anchors.label[at, None] != tile.label, scores, NONE))
        for slot, heaps in enumerate(self.heaps):
            least, most = self.least[at, slot, None], self.most[at, slot, None]
            nth = (best > most).sum(axis=1)[:, None] + np.arange(self.k)  # the window's first
            inside = nth < best.shape[1]
            nth = np.minimum(nth, best.shape[1] - 1)
            score = np.take_along_axis(best, nth, axis=1)
            inside &= (score >= least) & (score <= most) & (slot < self.anchors.positives[at, None])
            heaps.merge(at, np.where(inside, score, NONE), tile.id[np.take_along_axis(place, nth, axis=1)])

    def found(self) -> list[np.ndarray]:
        out = []
        for slot, heaps in enumerate(self.heaps):
            row, nth = np.nonzero(heaps.score != NONE)
            out.append((self.anchors.row[row], np.full_like(row, slot), heaps.id[row, nth], heaps.score[row, nth]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def met(anchors: DataFrame, rows: DataFrame, blocks: int, stripes: int, heaps: Callable[[Tile], Positives | Negatives]) -> DataFrame:
    """row, slot, id, score: what heaps keep of each block of anchors and each stripe of rows. A task holds a block of anchors and a tile of rows at a time."""
    block, stripe = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", "v"), F.lit(stripes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    columns = ["row", "vec_id", "label", "v", "positives"]
    asks = anchors.select(F.lit(0).alias("kind"), block.alias("block"), every(stripes).alias("stripe"), *columns)
    answers = rows.select(F.lit(1).alias("kind"), stripe.alias("stripe"), every(blocks).alias("block"), *columns[:-1], F.array().cast("array<bigint>").alias("positives"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, state, waiting, held = None, [], None, [], 0

        def meet() -> None:
            nonlocal state, held
            if state is None and own:
                state = heaps(Tile(own))
            if state is not None and waiting:
                tile = Tile(sorted_by_id(waiting))
                for k in range(0, len(state.anchors.id), TILE):
                    at = slice(k, min(k + TILE, len(state.anchors.id)))
                    state.meet(at, state.anchors.scores(at, tile), tile)
            waiting.clear()
            held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal state
            meet()
            out = state.found() if state is not None else [[]]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], NAMES)
            own.clear()
            state = None

        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("block", "stripe", "kind")])
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            start = 0
            for end in ends:
                now = tuple(keys[start, :2]) if end > start else key
                if now != key:
                    yield from closed()
                    key = now
                while start < end:
                    step = min(end - start, end - start if keys[start, 2] == 0 else TILE - held)
                    part = batch.slice(start, step)
                    if keys[start, 2] == 0:
                        own.append(part)
                    else:
                        waiting.append(part)
                        held += step
                        if held >= TILE:
                            meet()
                    start += step
        yield from closed()

    dealt = asks.unionByName(answers).repartition("block", "stripe").sortWithinPartitions("block", "stripe", "kind")
    return dealt.mapInArrow(run, "row long, slot long, id long, score long")


def sorted_by_id(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The batches as one, in order of vec_id, so that equal scores stand in that order in a tile."""
    return pa.Table.from_batches(batches).combine_chunks().sort_by("vec_id").to_batches()


def scaled(rows: DataFrame, vector: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """row (a number), vec_id, label, v (integers) and anchor of the rows that take part; identical rows count once."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), anchor.alias("anchor"), F.when(~odd, x).alias("x"))
    own = own.where("vec_id is not null and label is not null and x is not null")
    own = own.withColumn("v", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))).drop("x")
    norm = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    return own.where(norm < F.lit(2.0**63 * (1 - 1e-9))).distinct().withColumn("row", F.monotonically_increasing_id())


def mine(rows: DataFrame, label: Column, anchor: Column, vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best positives the
    hardest negatives whose score is from low to high per cent of the positive's.

    rows: vec_id and vector (an array of reals); label and anchor are expressions over them. A component x counts as floor(scale * x).
    Two passes over all pairs of an anchor and a row, in tiles: the first keeps each anchor's best rows of its label, the second the best of
    the others in each positive's window. A task keeps only its block of anchors and their heaps; heaps of tasks merge by rank.

    Rows with null vec_id, label or vector, or with a null, NaN or infinite component, take no part, nor do such whose squared length after
    scaling is 2**63 or more (their products would not fit 64 bits). Shorter vectors are padded with zeros; an empty one scores 0
    with all. Identical rows count once; different rows with one vec_id each count, but none is its namesake's positive. No rows give no rows; further columns
    are not read.
    """
    every, seen = stored_with(scaled(rows, vector, label, anchor, scale), "vectors", n=F.count("*"), anchors=F.count_if("anchor"))
    blocks, stripes = max(1, -(-seen["anchors"] // BLOCK)), max(1, -(-seen["n"] // STRIPE))
    asks = every.where("anchor").select("row", "vec_id", "label", "v")
    first = met(asks.withColumn("positives", F.array().cast("array<bigint>")), every, blocks, stripes, lambda a: Positives(a, positives))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    best = stored(first.withColumn("slot", place).where(F.col("slot") <= positives), "positives")
    lists = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "score"))).alias("s")).select("row", F.col("s.score").alias("positives"))  # a few a row
    second = met(asks.join(lists, "row"), every, blocks, stripes, lambda a: Negatives(a, negatives, low, high))
    rank = F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id"))
    hardest = second.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumn("slot", F.col("slot") + 1).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    named = best.withColumn("slot", F.col("slot").cast("long")).withColumnRenamed("id", "positive_id").withColumnRenamed("score", "positive_score")
    out = hardest.join(named, ["row", "slot"]).join(asks.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
