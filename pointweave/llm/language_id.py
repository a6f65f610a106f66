"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, by a forward algorithm; a text's is its words' product. The piece probabilities are
expected counts (forward and backward) over all training texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import slices, stored

#: A worker's memory by languages: numbers (one a word and language) that it keeps, after which it starts anew; those in one block of words, each
#: of which takes as many numbers as a word has characters; those of one long word; and words with their weights in training.
CACHE, BLOCK, LONG, WORDS = 1_200_000, 80_000, 8_000_000, 20_000
#: Probability of a character that is no piece, and added expected count of each piece.
UNKNOWN, ADDED = 1e-7, 0.05
START = "▁"
#: Languages that can be told apart: their probabilities are sent to all tasks.
MOST_LANGS = 500
#: Logarithm under which a product of probabilities could no longer be held in a float; and steps between rescalings of long words.
LEAST_LOG, SPAN = -600.0, 16
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    """Runs of letters (and of what counts as a letter in words, such as ²), in lower case; none if the text has no letter at all."""
    own = _WORD.findall((text or "").lower())
    return own if any(map(str.isalpha, own)) or any(c.isalpha() for w in own for c in w) else []


class Pieces:
    """The vocabulary's pieces of letters (and the word start), in lower case, found by a rolling hash of substrings."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        every = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
        own = sorted({p.lower() for p in every if (p == START or p.removeprefix(START).isalpha())})
        self.size, self.longest = len(own), max(map(len, own), default=1)
        keys = self.hashes(own)
        order = np.argsort(keys)
        self.keys, self.index = keys[order], order.astype(np.int32)
        # the top bits of a hash lead to a small range of the sorted keys
        self.shift = np.uint64(44)
        self.slots = np.searchsorted(self.keys, np.arange(2**20, dtype=np.uint64) << self.shift).astype(np.int32)
        self.deepest = int(np.diff(np.append(self.slots, len(self.keys))).max())

    @staticmethod
    def spread(h: np.ndarray) -> np.ndarray:
        return h * np.uint64(0x9E3779B97F4A7C15)

    def hashes(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.uint64)
        for k, text in enumerate(texts):
            h = 0
            for c in text:
                h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
            out[k] = h
        return self.spread(out)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key's piece, or -1."""
        at = self.slots[(keys >> self.shift).astype(np.int64)].astype(np.int64)
        out = np.full(len(keys), -1, dtype=np.int32)
        for d in range(self.deepest):
            k = np.minimum(at + d, len(self.keys) - 1)
            hit = self.keys[k] == keys
            out[hit] = self.index[k[hit]]
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words' lengths with the start sign, longest first; their places in words; pieces[k - 1, place, word]: the piece of k characters that ends there, or -1."""
        n = np.array([len(w) + 1 for w in words])
        order = np.argsort(-n, kind="stable")
        n = n[order]
        text = np.frombuffer("".join(START + words[k] for k in order).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        starts = np.concatenate([[0], np.cumsum(n)])
        code = np.zeros((int(n[0]), len(words)), dtype=np.uint64)
        place = np.arange(len(text)) - np.repeat(starts[:-1], n)
        code[place, np.repeat(np.arange(len(words)), n)] = text
        most = min(self.longest, len(code))
        pieces = np.full((most, *code.shape), -1, dtype=np.int32)
        h = np.zeros_like(code)
        for k in range(1, most + 1):
            # the hash of the k characters from a place on, put down where they end; words of at least k characters come first
            m = int(np.searchsorted(-n, -k, side="right"))
            h = h[: len(code) - k + 1, :m] * _BASE + code[k - 1 :, :m]
            inside = code[k - 1 :, :m] > 0
            found = np.full(h.shape, -1, dtype=np.int32)
            found[inside] = self.find(self.spread(h[inside]))
            pieces[k - 1, k - 1 :, :m] = found
        return n, order, pieces

    def apart(self, words: list[str], probs: np.ndarray) -> tuple[list[int], list[int]]:
        """Places of words whose products are sure to be held in a float, and of longer ones."""
        most = int(LEAST_LOG / min(-1.0, float(np.log(probs.min())))) if probs.size else 0
        sizes = [len(w) + 1 <= most for w in words]
        return [k for k, x in enumerate(sizes) if x], [k for k, x in enumerate(sizes) if not x]

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Log-probability of each word (rows) under each column of probs (piece by language; a last row for unknown characters)."""
        short, long = self.apart(words, probs)
        out = np.empty((len(words), probs.shape[1]))
        if short:
            out[short] = self.forward_short([words[k] for k in short], probs)
        for k in long:
            step = max(1, LONG // len(words[k]))
            for a in range(0, probs.shape[1], step):
                out[k, a : a + step] = self.forward_long(words[k], probs[:, a : a + step])[-1]
        return out

    def long_pieces(self, word: str) -> np.ndarray:
        """pieces[k - 1, place] of one word, with the number of the unknown for characters that are no piece and -1 for what is no piece."""
        text = np.frombuffer((START + word).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        pieces = np.full((min(self.longest, len(text)), len(text)), -1, dtype=np.int32)
        h = np.zeros_like(text)
        for k in range(1, len(pieces) + 1):
            h = h[: len(text) - k + 1] * _BASE + text[k - 1 :]
            pieces[k - 1, k - 1 :] = self.find(self.spread(h))
        pieces[0][pieces[0] < 0] = self.size
        return pieces

    def forward_long(self, word: str, probs: np.ndarray, pieces: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of the word's start up to each place (rows), by the same recursion with a scale of its own for every SPAN places."""
        pieces = self.long_pieces(word) if pieces is None else pieces
        n, most = pieces.shape[1], len(pieces)
        padded = np.vstack([probs, np.zeros((1, probs.shape[1]))])  # the last row stands for -1
        alpha = np.zeros((most + SPAN, probs.shape[1]))  # rows up to `most` are the last places before this span
        alpha[most - 1] = 1
        scale = np.zeros(probs.shape[1])
        out = np.empty((n + 1, probs.shape[1]))
        out[0] = 0
        for lo in range(0, n, SPAN):
            hi = min(n, lo + SPAN)
            p = padded[pieces[::-1, lo:hi].T]  # place, longest piece first, language
            for t in range(hi - lo):
                alpha[most + t] = (alpha[t : most + t] * p[t]).sum(axis=0)
            here = alpha[most : most + hi - lo]
            out[lo + 1 : hi + 1] = np.log(here) + scale
            kept = alpha[hi - lo : hi - lo + most].copy()
            top = kept.max(axis=0)
            scale = scale + np.log(top)
            alpha[:most] = kept / top
        return out

    def expected_long(self, word: str, probs: np.ndarray) -> np.ndarray:
        """Expected number of each piece in one word of any length."""
        pieces = self.long_pieces(word)
        n = pieces.shape[1]
        forward = self.forward_long(word, probs, pieces)[:, 0]
        # backward: the same recursion over the pieces by where they start, from the end
        turned = np.full_like(pieces, -1)
        for k in range(len(pieces)):
            turned[k, k:] = pieces[k, k:][::-1]
        backward = self.forward_long(word, probs, turned)[::-1, 0]
        out, logs = np.zeros(self.size + 1), np.log(probs[:, 0])
        for k in range(len(pieces)):
            at = np.flatnonzero(pieces[k] >= 0)
            own = pieces[k, at]
            out += np.bincount(own, np.exp(forward[at - k] + logs[own] + backward[at + 1] - forward[n]), minlength=self.size + 1)
        return out

    def forward_short(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        n, order, pieces = self.lattice(words)
        alpha = np.zeros((len(pieces[0]) + 1, len(words), probs.shape[1]))
        alpha[0] = 1
        for t in range(1, len(alpha)):
            m = int(np.searchsorted(-n, -t, side="right"))  # words of at least t characters come first
            for k in range(1, min(self.longest, t) + 1):
                piece = pieces[k - 1, t - 1, :m]
                if k == 1:
                    alpha[t, :m] += alpha[t - 1, :m] * probs[np.where(piece < 0, self.size, piece)]
                else:
                    has = np.flatnonzero(piece >= 0)
                    alpha[t, has] += alpha[t - k, has] * probs[piece[has]]
        out = np.empty((len(words), probs.shape[1]))
        out[order] = np.log(alpha[n, np.arange(len(words))])
        return out

    def expected(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected number of each piece in the words (weights: word by language), over all segmentations under probs (one column)."""
        short, long = self.apart(words, probs)
        out = np.zeros((self.size + 1, weights.shape[1]))
        if short:
            out += self.expected_short([words[k] for k in short], weights[short], probs)
        for k in long:
            out += self.expected_long(words[k], probs)[:, None] * weights[k]
        return out

    def expected_short(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        n, order, pieces = self.lattice(words)
        p, top = probs[:, 0], len(pieces[0])
        alpha, beta = np.zeros((top + 1, len(words))), np.zeros((top + 1, len(words)))
        alpha[0] = 1
        beta[n, np.arange(len(words))] = 1
        steps = []
        for t in range(1, top + 1):
            m = int(np.searchsorted(-n, -t, side="right"))
            for k in range(1, min(self.longest, t) + 1):
                piece = pieces[k - 1, t - 1, :m]
                has = np.arange(m) if k == 1 else np.flatnonzero(piece >= 0)
                own = np.where(piece[has] < 0, self.size, piece[has])
                alpha[t, has] += alpha[t - k, has] * p[own]
                steps.append((t, k, has, own))
        for t, k, has, own in reversed(steps):
            beta[t - k, has] += beta[t, has] * p[own]
        total, ordered = alpha[n, np.arange(len(words))], weights[order]
        out = np.zeros((self.size + 1, weights.shape[1]))
        for t, k, has, own in steps:
            share = alpha[t - k, has] * p[own] * beta[t, has] / total[has]
            for lang in range(weights.shape[1]):
                out[:, lang] += np.bincount(own, share * ordered[has, lang], minlength=self.size + 1)
        return out


@lru_cache(maxsize=2)
def pieces(model_path: str) -> Pieces:
    return Pieces(model_path)


def held_out(column: str = "doc_id") -> F.Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, model_path: str) -> DataFrame:
    """lang, piece and its expected count, over all documents that have a lang and are not held out.

    Each task sums the counts of its own texts, so a task sends a row for each language and piece at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model_path)
        flat = np.full((vocabulary.size + 1, 1), 1 / vocabulary.size)
        flat[-1] = UNKNOWN
        langs: dict[str, int] = {}
        total = np.zeros((vocabulary.size + 1, 0))

        def add(count: dict[tuple[str, int], int]) -> None:
            nonlocal total
            own: dict[str, int] = {}
            for word, _ in count:
                own.setdefault(word, len(own))
            word, lang = (np.fromiter(x, dtype=np.int64, count=len(count)) for x in ((own[w] for w, _ in count), (k for _, k in count)))
            times = np.fromiter(count.values(), dtype=float, count=len(count))
            order = np.argsort(word, kind="stable")
            word, lang, times = word[order], lang[order], times[order]
            total = np.pad(total, ((0, 0), (0, len(langs) - total.shape[1])))
            words = list(own)
            for k in range(0, len(words), WORDS):
                a, b = np.searchsorted(word, (k, k + WORDS))
                weights = np.zeros((min(WORDS, len(words) - k), len(langs)))
                weights[word[a:b] - k, lang[a:b]] = times[a:b]
                total += vocabulary.expected(words[k : k + WORDS], weights, flat)

        count: dict[tuple[str, int], int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = langs.setdefault(lang, len(langs))
                for word in words_of(text):
                    count[word, k] = count.get((word, k), 0) + 1
                if len(count) > 300_000:
                    add(count)
                    count = {}
        if count:
            add(count)
        for lang, k in langs.items():
            if k < total.shape[1]:
                has = np.flatnonzero(total[:, k])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(has), pa.string()), pa.array(has.astype(np.int32)), pa.array(total[has, k])], ["lang", "piece", "n"])

    rows = docs.where(F.col("lang").isNotNull() & ~held_out()).select("text", "lang")
    return rows.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, model_path: str) -> tuple[list[str], np.ndarray]:
    """Languages and the probability of each piece in each; the driver gets a number for each language and piece of the vocabulary, a language at a time.

    Raises ValueError if there are over MOST_LANGS languages, as where the column holds something else."""
    counts = stored(counts, "piece-counts")
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").limit(MOST_LANGS + 1).collect()]
    if len(langs) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    place = {lang: k for k, lang in enumerate(sorted(langs))}
    n = np.full((pieces(model_path).size + 1, len(langs)), ADDED)
    # a row has at most as many entries as the vocabulary
    rows = counts.groupBy("lang").agg(F.collect_list("piece").alias("pieces"), F.collect_list("n").alias("n"))
    for row in rows.toLocalIterator():
        n[row.pieces, place[row.lang]] += row.n
    n[-1] = 0
    if langs:
        n /= n.sum(axis=0)
    n[-1] = UNKNOWN
    return list(place), n


class Scorer:
    """Log-probabilities of texts, with those of repeated words kept."""

    def __init__(self, model_path: str, probs: np.ndarray):
        self.pieces, self.probs = pieces(model_path), probs
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.score = np.zeros((0, self.probs.shape[1]))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its log-probability under each language, and its number of words.

        Words are scored in runs of the texts' words, each of as many as may be kept; a text may lie in several."""
        own = [words_of(t) for t in texts]
        langs = max(1, self.probs.shape[1])
        n = np.array([len(x) for x in own])
        of, every = np.repeat(np.arange(len(own)), n), [w for x in own for w in x]
        out = np.zeros((len(own), self.probs.shape[1]))
        run = max(1, CACHE // langs)
        for a in range(0, len(every), run):
            scores, of_run = self.words(every[a : a + run], langs), of[a : a + run]
            first = np.flatnonzero(np.diff(of_run, prepend=-1))
            for lang in range(out.shape[1]):
                out[of_run[first], lang] += np.add.reduceat(self.score[scores, lang], first)
        return out, n

    def words(self, words: list[str], langs: int) -> np.ndarray:
        """Rows of self.score of the words."""
        if len(self.place) * langs > CACHE:
            self.clear()
        place, known = self.place, len(self.place)
        flat = np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int64, count=len(words))
        new, step = list(islice(place, known, None)), max(1, BLOCK // langs)
        if new:
            scores = [self.pieces.forward(new[k : k + step], self.probs) for k in range(0, len(new), step)]
            self.score = np.concatenate([self.score, *scores])
        return flat


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray, model_path: str) -> DataFrame:
    """doc_id, lang_pred and score (its posterior under equal priors) of each whole text.

    `und` with score 0 if the text is null or has no letter, or if nothing was learned; ties go to the first language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast((langs, probs))  # languages x pieces of the vocabulary: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = sent.value
        scorer = Scorer(model_path, p)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 2_000_000):
                pred, score = ["und"] * (b - a), [0.0] * (b - a)
                if names:
                    logs, n = scorer.texts(texts[a:b])
                    best = logs.argmax(axis=1)
                    post = 1 / np.exp(np.minimum(logs - logs.max(axis=1, keepdims=True), 0)).sum(axis=1)
                    for k in np.flatnonzero(n):
                        pred[k], score[k] = names[best[k]], float(post[k])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, model_path: str, training: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document (columns doc_id, text, lang), learned from training (else docs).

    Learns from text and non-null lang of documents that are not held out; lang is no input of a prediction. Null,
    empty or letterless text gets `und`. A null doc_id counts as held out. Repeated rows give repeated rows, an empty table
    none; further columns are not read. Over MOST_LANGS languages to learn from are an error.
    """
    langs, probs = probabilities(train(docs if training is None else training, model_path), model_path)
    return predict(docs, langs, probs, model_path).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
