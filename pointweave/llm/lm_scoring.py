"""Masked pseudo-likelihood: a network over a window of two tokens a side predicts each token from both sides.

Tokens are lower-case words. A word's probability is that of its class, given its four neighbours' classes, times that of
the word in its class. The most frequent words have a class each, the others share classes by hash; the network, trained in
numpy, has a hidden layer and an output in two levels (group, then class in the group). Words in their classes follow the
counts of all documents: rare words by those of the other documents, and what no other document has is spelled out. The
counts grow with the corpus; a document's score is the sum over its tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import slices, stored
from pointweave.llm.near_dedup import _LOWER_CASE

#: Groups of classes and classes in each; class 0 stands beyond both ends, then come the frequent words, then the shared classes.
GROUPS, IN_GROUP, SHARED = 16, 32, 64
CLASSES = GROUPS * IN_GROUP
FREQUENT = CLASSES - 1 - SHARED
#: Neighbours on a side, and the hidden layer's width.
SIDE, HIDDEN = 2, 32
#: Words that a worker keeps; then it starts anew.
CACHE = 400_000
#: Words that make up one in MOST_COMMON of all tokens, and occur LEAST_COMMON times, are sent to all tasks with their counts.
MOST_COMMON, LEAST_COMMON = 1 << 20, 64
#: What is taken off the count of a word for the words that nobody has, and the symbols (bytes and an end) that spell these.
DISCOUNT, SYMBOLS = 0.5, 257
#: Sixteenths of the documents that the rounds of training take; each document is in one of them.
ROUNDS = (1, 3, 12)
#: Characters of texts whose tokens are trained on together, in an order of their own; a longer text is a part of its own.
TOGETHER = 1_000_000
#: Tokens of a shard, most shards of a round, and parts in which the weights are summed.
SHARD_TOKENS, MOST_SHARDS, WEIGHT_PARTS = 2_000_000, 1 << 16, 64
BATCH, RATE = 4096, 0.3


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-case words (bytes) of binary texts in a row, and how many each text has; null has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string()).fill_null("")))
    flat, n = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end of a text has an empty word beside it
    if pc.sum(full).as_py() != len(flat):
        n = np.bincount(np.repeat(np.arange(len(n)), n)[full.to_numpy(zero_copy_only=False)], minlength=len(n))
        flat = flat.filter(full)
    return flat.view(pa.binary()), n


def word_counts(docs: DataFrame) -> DataFrame:
    """word (lower-case bytes) and its number in all documents, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                summed = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
                yield from summed.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()
                held.clear()

        for batch in batches:
            counted = words_of(batch.column(0))[0].value_counts()
            held.append(pa.table({"word": counted.field("values"), "n": counted.field("counts")}))
            if sum(map(len, held)) > CACHE:
                yield from out()
        yield from out()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


hash_of = xxhash.xxh3_64_intdigest


def shared_class(hashes: np.ndarray) -> np.ndarray:
    return 1 + FREQUENT + (hashes % np.uint64(SHARED)).astype(np.int64)


@dataclass
class Counts:
    """What is known of the words of all documents: the frequent ones in order; hashes (sorted) and counts of the common ones; tokens
    and different words of each class. Its size is bounded by FREQUENT, MOST_COMMON and CLASSES."""

    frequent: list[bytes]
    hashes: np.ndarray
    n: np.ndarray
    tokens: np.ndarray
    words: np.ndarray


def counts(counted: DataFrame) -> Counts:
    """Counts from all words and their numbers."""
    frequent = [(bytes(r.word), r.n) for r in counted.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COMMON, -(-total // MOST_COMMON))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w for w, _ in frequent}
        for batch in batches:
            pairs = [(hash_of(w), n) for w, n in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True) if w not in known]
            h, n = np.array([x for x, _ in pairs], dtype=np.uint64), np.array([x for _, x in pairs], dtype=np.int64)
            common = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(shared_class(h)), pa.array(np.where(common, h, 0).view(np.int64)), pa.array(common), pa.array(n)], ["class", "hash", "common", "n"])

    summed = counted.select("word", "n").mapInArrow(run, "class long, hash long, common boolean, n long").groupBy("class", "hash", "common").agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    found = summed.toArrow()  # a row for each common word and each shared class
    of, hashes, common, n, words = (found.column(k).to_numpy() for k in range(5))
    common = common.astype(bool)
    tokens, kinds = (np.bincount(of.astype(np.int64), x, minlength=CLASSES) for x in (n, words))
    tokens[1 : len(frequent) + 1], kinds[1 : len(frequent) + 1] = [n for _, n in frequent], 1
    hashes, n = np.ascontiguousarray(hashes[common]).view(np.uint64), n[common]
    order = np.argsort(hashes)
    return Counts([w for w, _ in frequent], hashes[order], n[order], tokens, kinds)


class Words(dict):
    """Numbers of words, and arrays over these numbers: class; log P(word | class), NaN for rare words; hash; and for rare words the
    log of their class's tokens and log P of a word that nobody else has."""

    def __init__(self, known: Counts):
        super().__init__()
        self.known, self.number = known, {w: k + 1 for k, w in enumerate(known.frequent)}
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.columns = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64), np.empty(0), np.empty(0)]

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k

    def learn(self, flat: pa.Array) -> np.ndarray:
        """Numbers of words (bytes) in a row; the columns then have them all."""
        if len(self) > CACHE:
            self.empty()
        found = flat.dictionary_encode()
        different = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() makes a scalar of each
        ids = np.fromiter(map(self.__getitem__, different), dtype=np.int64, count=len(different))
        if self.new:
            own, known = self.new, self.known
            h = np.fromiter(map(hash_of, own), dtype=np.uint64, count=len(own))
            of = np.fromiter(map(self.number.get, own, repeat(0)), dtype=np.int64, count=len(own))
            frequent = of > 0
            of = np.where(frequent, of, shared_class(h))
            size = np.log(np.maximum(known.tokens[of], 1))
            share = np.where(frequent, 0.0, np.nan)
            if len(known.hashes):
                at = np.minimum(np.searchsorted(known.hashes, h), len(known.hashes) - 1)
                common = (known.hashes[at] == h) & ~frequent
                share[common] = np.log(known.n[at[common]] - DISCOUNT) - size[common]
            length = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            spelled = np.log(DISCOUNT * np.maximum(known.words[of], 1)) - size - (length + 1) * math.log(SYMBOLS)
            self.columns = [np.concatenate(x) for x in zip(self.columns, (of, share, h, size, spelled), strict=True)]
            self.new = []
        return ids.take(found.indices.to_numpy())

    def classes(self, texts: list[list[bytes]]) -> np.ndarray:
        ids = self.learn(pa.array(chain.from_iterable(texts), pa.binary()))
        return self.columns[0][ids]


def split(texts: list[bytes | None]) -> list[list[bytes]]:
    return [(t or b"").translate(_LOWER_CASE).split() for t in texts]


def windows(classes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row for each token: its class and those of its neighbours, SIDE before and SIDE after it in its text (n: tokens of each text)."""
    ends = np.cumsum(n + 2 * SIDE)
    padded = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    at = np.arange(int(n.sum())) + np.repeat(2 * SIDE * np.arange(len(n)) + SIDE, n)
    padded[at] = classes
    return np.column_stack([padded.take(at + k) for k in (0, *range(-SIDE, 0), *range(1, SIDE + 1))])


class Network:
    """A row for each neighbour's class adds up to the hidden layer; softmaxes over the groups and over the classes of a group."""

    SHAPES = [(2 * SIDE, CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, IN_GROUP), (GROUPS, IN_GROUP)]

    def __init__(self, flat: np.ndarray):
        self.flat, self.parts, at = flat.astype(np.float32), [], 0
        for shape in self.SHAPES:
            self.parts.append(self.flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    @classmethod
    def start(cls, tokens: np.ndarray, seed: int = 1) -> Network:
        """Small random weights, and biases by which every class has its share of the tokens."""
        rng = np.random.default_rng(seed)
        flat = np.concatenate([(rng.standard_normal(s) * (0.1 if len(s) > 1 else 0)).ravel() for s in cls.SHAPES])
        net, of = cls(flat), (tokens + 0.5).reshape(GROUPS, IN_GROUP)
        net.parts[3][:] = np.log(of.sum(axis=1))
        net.parts[5][:] = np.log(of)
        return net

    @staticmethod
    def chosen(z: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P of place k[i] of each column i of scores, and the columns' totals; the columns become their probabilities times these totals."""
        z -= z.max(axis=0)
        own = z[k, np.arange(len(k))]
        np.exp(z, out=z)
        total = z.sum(axis=0)
        return own - np.log(total), total

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        t, b = self.parts[:2]
        h = t[0].take(rows[:, 1], axis=0)
        for k in range(1, 2 * SIDE):
            h += t[k].take(rows[:, 1 + k], axis=0)
        h += b
        return np.tanh(h, out=h)

    def by_group(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the rows by the group of their token, and where each group starts in it."""
        group = (rows[:, 0] // IN_GROUP).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        return order, np.searchsorted(group[order], np.arange(GROUPS + 1))

    def scores(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A column for each row of the hidden layer: scores of the groups, and of the classes in the row's own group."""
        _, _, a, a0, b, b0 = self.parts
        z = a.T @ h.T
        z += a0[:, None]
        y = np.empty((IN_GROUP, len(h)), dtype=np.float32)
        for g in range(GROUPS):
            lo, hi = starts[g], starts[g + 1]
            if lo < hi:
                y[:, lo:hi] = b[g].T @ h[lo:hi].T
                y[:, lo:hi] += b0[g][:, None]
        return z, y

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """log P(class | neighbours' classes) of each row of windows()."""
        out = np.empty(len(rows), dtype=np.float32)
        for k in range(0, len(rows), 1 << 13):
            part = rows[k : k + (1 << 13)]
            order, starts = self.by_group(part)
            part = part.take(order, axis=0)
            z, y = self.scores(self.hidden(part), starts)
            out[k + order] = self.chosen(z, part[:, 0] // IN_GROUP)[0] + self.chosen(y, part[:, 0] % IN_GROUP)[0]
        return out

    def train(self, rows: np.ndarray, square: list[np.ndarray], rate: float = RATE) -> float:
        """One pass over rows of windows(), in their order, by Adagrad (square: its sums, kept between calls); returns the mean loss."""
        _, _, a, _, b, b0 = self.parts
        loss = 0.0
        for k in range(0, len(rows), BATCH):
            part = rows[k : k + BATCH]
            order, starts = self.by_group(part)
            part = part.take(order, axis=0)
            n, each = np.float32(len(part)), np.arange(len(part))
            h = self.hidden(part)
            z, y = self.scores(h, starts)
            for x, own in ((z, part[:, 0] // IN_GROUP), (y, part[:, 0] % IN_GROUP)):
                found, total = self.chosen(x, own)
                loss -= float(found.sum())
                x /= total * n
                x[own, each] -= 1 / n
            gh, gb, gb0 = z.T @ a.T, np.zeros_like(b), np.zeros_like(b0)
            for g in range(GROUPS):
                lo, hi = starts[g], starts[g + 1]
                if lo < hi:
                    gb[g], gb0[g] = (y[:, lo:hi] @ h[lo:hi]).T, y[:, lo:hi].sum(axis=1)
                    gh[lo:hi] += y[:, lo:hi].T @ b[g].T
            gh *= 1 - h * h
            gt = np.zeros_like(self.parts[0])
            for p in range(2 * SIDE):
                near = part[:, 1 + p].astype(np.uint16)
                order = np.argsort(near, kind="stable")
                near = near[order]
                first = np.concatenate([[0], np.flatnonzero(near[1:] != near[:-1]) + 1])
                # two sums at a time
                gt[p][near[first]] = np.add.reduceat(gh.take(order, axis=0).view(np.complex64), first).view(np.float32)
            for x, s, d in zip(self.parts, square, (gt, gh.sum(axis=0), (z @ h).T, z.sum(axis=1), gb, gb0), strict=True):
                s += d * d
                x -= rate * d / np.sqrt(s)
        return loss / max(1, len(rows))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Texts in lists of about TOGETHER characters, wherever the batches end."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if held and size + len(text) > TOGETHER:
                yield held
                held, size = [], 0
            held.append(text)
            size += len(text)
    if held:
        yield held


def fit(docs: DataFrame, known: Counts) -> Network:
    """The network, trained on all documents in rounds of growing size.

    A hash of the row deals each document to a round and to a shard of it, and orders it there; the number of shards follows from the number of
    tokens, so what is learned does not depend on how the table is stored or on the cluster. All shards of a round start from
    the same weights, and the new ones are averaged by the shards' tokens, each part of them in a task.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        seen: Counter[int] = Counter()
        for batch in batches:
            for part, weights, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0.0) + n * np.frombuffer(weights, dtype=np.float32).astype(float)
                seen[part] += n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([(x / seen[k]).astype(np.float32).tobytes() for k, x in sums.items()], pa.binary())], ["part", "weights"])

    sc = docs.sparkSession.sparkContext
    net, total = Network.start(known.tokens), int(known.tokens.sum())
    shared = sc.broadcast(known)
    # by text and id, so that copies of one text are dealt apart
    dealt = docs.select(F.col("text").cast("binary").alias("text"), F.xxhash64("text", "doc_id").alias("hash")).where("text is not null")
    low = 0
    for round_, share in enumerate(ROUNDS):
        own = F.pmod("hash", F.lit(16))
        rows = dealt.where((own >= low) & (own < low + share))
        low += share
        shards = max(1, min(MOST_SHARDS, -(-total * share // (16 * SHARD_TOKENS))))
        start = sc.broadcast(net.flat)

        def run(batches: Iterator[pa.RecordBatch], round_: int = round_, start=start) -> Iterator[pa.RecordBatch]:
            own, words = Network(start.value), Words(shared.value)
            square = [np.full_like(p, 1e-4) for p in own.parts]
            seen = 0
            for texts in together(batches):
                flat, n = words_of(pa.array(texts, pa.binary()))
                ids = words.learn(flat)
                found = windows(words.columns[0][ids], n)
                own.train(found.take(np.random.default_rng(seen).permutation(len(found)), axis=0), square, RATE / (1 + round_))
                seen += len(found)
            if seen:
                cut = [x.tobytes() for x in np.array_split(own.flat, WEIGHT_PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(WEIGHT_PARTS), pa.int64()), pa.array(cut, pa.binary()), pa.array([seen] * WEIGHT_PARTS, pa.int64())], ["part", "weights", "n"])

        in_shards = rows.repartition(shards, F.col("hash")).sortWithinPartitions("hash", "text").select("text")
        passed = in_shards.mapInArrow(run, "part long, weights binary, n long").repartition(WEIGHT_PARTS, "part").sortWithinPartitions("part", "n", "weights").mapInArrow(summed, "part long, weights binary").collect()
        if passed:
            net = Network(np.concatenate([np.frombuffer(r.weights, dtype=np.float32) for r in sorted(passed)]))
        start.unpersist()
    return net


@dataclass
class Model:
    """What score() needs: the words' counts and the network's weights."""

    known: Counts
    flat: np.ndarray


def train(docs: DataFrame) -> Model:
    known = counts(stored(word_counts(docs), "words"))
    return Model(known, fit(docs, known).flat)


def partial_scores(docs: DataFrame, model: Model) -> DataFrame:
    """row (a number of its own), doc_id, n_tokens, likelihood (but for rare words) and rare: hash, number in the text, log of the
    class's tokens and log P if no other text has it, of each different rare word."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = Words(sent.value.known), Network(sent.value.flat)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, n = words_of(batch.column(1).slice(a, b - a))
                ids = words.learn(flat)
                of, share, hashes, size, spelled = words.columns
                each = net.log_probabilities(windows(of[ids], n)).astype(float)
                own = share[ids]
                rare = np.isnan(own)
                each[~rare] += own[~rare]
                text = np.repeat(np.arange(b - a), n)
                sums = np.bincount(text, each, minlength=b - a)
                key, k = np.unique(text[rare] * len(words) + ids[rare], return_counts=True)
                doc, word = np.divmod(key, max(1, len(words)))
                offsets = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                item = pa.StructArray.from_arrays([pa.array(hashes[word].view(np.int64)), pa.array(k), pa.array(size[word].astype(np.float32)), pa.array(spelled[word].astype(np.float32))], ["hash", "k", "size", "spelled"])
                columns = [pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(n), pa.array(sums), pa.ListArray.from_arrays(offsets, item)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "likelihood", "rare"])
                row += b - a

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "row long, doc_id long, n_tokens long, likelihood double, rare array<struct<hash:long,k:long,size:float,spelled:float>>")


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, pseudo_perplexity and n_new (tokens of rare words that no other text of docs has) of every whole text.

    log_likelihood is the sum over all tokens of log P(class | two neighbours a side) + log P(word | class). Without a model
    one is trained on docs. A rare word counts as often as the other texts of docs have it; if none has, its bytes are spelled.
    Null, empty or blank text has no tokens, likelihood 0 and perplexity null. Repeated rows give repeated rows (and are
    other texts to each other), an empty table none; further columns are not read.
    """
    rows = stored(partial_scores(docs, model or train(docs)), "scores")
    rare = rows.select("row", F.explode("rare").alias("w")).select("row", "w.*")
    others = (F.sum("k").over(Window.partitionBy("hash")) - F.col("k")).alias("others")
    seen = F.when(F.col("others") > 0, F.log(F.col("others") - DISCOUNT) - F.col("size")).otherwise(F.col("spelled"))
    terms = rare.select("row", "k", "size", "spelled", others).groupBy("row").agg(F.sum(F.col("k") * seen).alias("rest"), F.sum(F.when(F.col("others") == 0, F.col("k"))).alias("new"))
    whole = F.col("likelihood") + F.coalesce("rest", F.lit(0.0))
    out = rows.select("row", "doc_id", "n_tokens", "likelihood").join(terms, "row", "left")
    out = out.select("doc_id", "n_tokens", whole.alias("log_likelihood"), F.coalesce("new", F.lit(0)).cast("long").alias("n_new"))
    return out.withColumn("pseudo_perplexity", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_likelihood") / F.col("n_tokens"))))
