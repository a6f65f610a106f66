"""Packing tokenised documents into training sequences.

Pieces are vectors (tokens, segments, loss-bearing tokens) and sequences are bins with one limit for each
dimension. A bin takes the piece whose demand has the largest dot product with what the bin has left; if no whole
piece fits, that piece is cut, so a sequence ends full or at a power of two.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import slices

SEPARATOR = b"\0\0\0\0"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"
#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A task's sequences are numbered from its partition number shifted by so many bits.
TASK_BITS = 36


class VocabularyTokenizer:
    """Ids of whole texts from a byte-level BPE file of the tokenizers library.

    The file's vocabulary and pattern run in tiktoken's engine, which takes a third of the library's CPU time. Its merges go by id, so
    the file's merges must be in order of the ids that they make. A text that has a special token's string goes to the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {t["content"] for t in file["added_tokens"]}
        vocabulary = {t: i for t, i in file["model"]["vocab"].items() if t not in added}
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
        kind = file["pre_tokenizer"]
        if made != sorted(made) or file["normalizer"] or file["post_processor"] or (kind["type"], kind["use_regex"], kind["add_prefix_space"]) != ("ByteLevel", True, False):
            raise ValueError("not a plain byte-level BPE file with merges in order of their ids")
        # the file writes bytes as characters: printable ones as themselves, the others from 256 on
        alphabet = sorted(ByteLevel.alphabet())
        own = [ord(c) for c in alphabet if ord(c) < 256]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)).difference(own)))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}
        self.special = sorted(added)
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> VocabularyTokenizer:
    return VocabularyTokenizer(path)


class Packer:
    """Sequences from a stream of documents, with a bounded pool of waiting pieces.

    A piece is [document, start, length, loss-bearing tokens before its start]; the tokens of a document from its
    `free` first on bear loss, but for the separator.
    """

    def __init__(self, tokens: int, segments: int, loss: int, pool: int, base: int):
        self.limit, self.pool_size, self.number = np.array([tokens, segments, loss], dtype=float), pool, base
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.waiting: list[tuple[int, int, int]] = []
        self.size: dict[int, tuple[int, int]] = {}

    def bearing(self, doc: int, start: int, length: int) -> int:
        n, free = self.size[doc]
        return max(0, min(start + length, n - 1) - max(start, free))

    def longest(self, doc: int, start: int, most: int, loss: int) -> int:
        """Length of the longest piece from start that keeps to both limits."""
        n, free = self.size[doc]
        most = min(most, n - start)
        if self.bearing(doc, start, most) <= loss:
            return most
        return max(0, free - start) + loss

    def add(self, doc: int, n: int, free: int) -> Iterator[list[tuple[int, int, int]]]:
        self.size[doc] = (n, free)
        at = 0
        while n - at >= self.tokens and self.longest(doc, at, self.tokens, self.loss) == self.tokens:
            yield [(doc, at, self.tokens)]
            at += self.tokens
        if at < n:
            self.waiting.append((doc, at, n - at))
            while len(self.waiting) >= self.pool_size:
                yield from self.fill()

    def fill(self) -> Iterator[list[tuple[int, int, int]]]:
        """One sequence from the pool, ended where it is full, or at the largest power of two that it reaches."""
        need = np.array([(length, 1, self.bearing(d, s, length)) for d, s, length in self.waiting], dtype=float)
        share = need / self.limit
        left, chosen, open_ = self.limit.copy(), [], np.ones(len(need), dtype=bool)
        while left[0] >= 1 and left[1] >= 1 and open_.any():
            worth = share @ (left / self.limit)
            fits = open_ & (need <= left).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, worth, -1)))
                chosen.append((k, self.waiting[k][2]))
            else:
                k = int(np.argmax(np.where(open_, worth, -1)))
                d, s, _ = self.waiting[k]
                cut = self.longest(d, s, int(left[0]), int(left[2]))
                if cut < 1:
                    break
                chosen.append((k, cut))
            d, s, _ = self.waiting[k]
            open_[k] = False
            left -= (chosen[-1][1], 1, self.bearing(d, s, chosen[-1][1]))
        total = sum(n for _, n in chosen)
        keep = total if total == self.tokens else 1 << (total.bit_length() - 1)
        sequence, rest = [], []
        for k, n in chosen:
            d, s, whole = self.waiting[k]
            take = min(n, keep)
            keep -= take
            if take:
                sequence.append((d, s, take))
            if take < whole:
                rest.append((d, s + take, whole - take))
        self.waiting = [x for x, free in zip(self.waiting, open_, strict=True) if free] + rest
        yield sequence

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        while self.waiting:
            yield from self.fill()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = 1024,
    max_segments: int = 64,
    max_loss: int | None = None,
    prompt_tokens: str | None = None,
    pool: int = 64,
    with_ids: bool = True,
) -> DataFrame:
    """Pack every document (columns doc_id, text) into sequences of at most max_tokens ids.

    A document is its ids and then id 0. prompt_tokens names a column with the number of a document's first tokens that
    bear no loss (null: 0); the separator bears none either. max_loss (null: max_tokens) limits the loss-bearing tokens of
    a sequence, max_segments its pieces. Each task packs its own documents with a pool of at most `pool` waiting pieces, so
    memory is bounded and no row crosses tasks; a sequence is full, or a power of two long.

    Returns a row per piece, with its ids (little-endian, unsigned, 32 bit) if with_ids. Null or empty text: the separator alone.
    Repeated rows are packed as often as they occur, under their doc_id; a null doc_id stays null. An empty table gives no
    rows. Further columns of docs are not read.
    """
    if min(max_tokens, max_segments, max_loss or 1, pool) < 1:
        raise ValueError("the limits must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss or max_tokens, pool, 0)
        number = TaskContext.get().partitionId() << TASK_BITS
        known: dict[int, tuple[int | None, memoryview]] = {}
        serial = 0

        def rows(sequences: Iterator[list[tuple[int, int, int]]]) -> Iterator[tuple]:
            nonlocal number
            for sequence in sequences:
                at = 0
                for d, start, length in sequence:
                    doc_id, raw = known[d]
                    piece = raw[4 * start : 4 * (start + length)]
                    yield doc_id, start, length, zlib.crc32(piece), len(raw) // 4, number, at, packer.bearing(d, start, length), bytes(piece) if with_ids else None
                    at += length
                number += 1

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 8 + [pa.binary()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            ids, texts, prompts = (batch.column(k).to_pylist() for k in range(3))
            for a, b in slices(texts):
                out: list[tuple] = []
                for doc_id, raw, free in zip(ids[a:b], map(words.encode, (t or "" for t in texts[a:b])), prompts[a:b], strict=True):
                    known[serial] = (doc_id, memoryview(raw + SEPARATOR))
                    out += rows(packer.add(serial, len(raw) // 4 + 1, max(0, free or 0)))
                    serial += 1
                alive = {d for d, _, _ in packer.waiting}
                known = {d: x for d, x in known.items() if d in alive}
                packer.size = {d: x for d, x in packer.size.items() if d in alive}
                if out:
                    yield batch_of(out)
        if out := list(rows(packer.finish())):
            yield batch_of(out)

    prompt = F.col(prompt_tokens).cast("long") if prompt_tokens else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), prompt.alias("prompt")).mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, segments (array of doc_id, start, length) and ids (binary), from pack(with_ids=True)."""
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    ordered = F.array_sort(F.collect_list(piece))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("p")).select(
        "sequence_id",
        "n_tokens",
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("segments"),
        F.aggregate(F.col("p"), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
    )
