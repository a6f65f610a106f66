"""Encoding and decoding with merge-type sentencepiece vocabularies.

Symbols start as single characters; an agenda holds the adjacent pairs that are pieces, best score first and then
leftmost, and merges them until it is empty. Characters that are no piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import chain, filterfalse, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import arrow_map, slices

SPACE = "▁"
#: Parts whose ids a worker keeps, the latter half of them met of late; others are learned anew.
CACHE = 400_000
#: Parts of fewer characters go through their agendas together; longer ones are not kept.
WIDEST = 28
#: Characters that are cut at a time, and parts in a call of the library.
CUT_TOGETHER, CHECKED_TOGETHER = 4_000_000, 500
NEVER = 2**31 - 1


class PieceCodec:
    """The vocabulary of a merge-type model file, with an encoder and a decoder of its own.

    Two neighbouring characters that stand side by side in no piece can never be merged, so a text is cut there and every
    part is encoded by itself; parts that come again are looked up. `check` compares what is newly encoded with the
    sentencepiece library and raises ValueError at a difference.
    """

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check = check
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        self.text_of = {i: sp.id_to_piece(i).replace(SPACE, " ") for i in plain}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        # of pieces whose text doesn't depend on others
        self.quick = self.text_of | {i: chr(b) for i, b in self.byte_of.items() if b < 128}
        self.unknown = sp.unk_id()
        self.names = [str(i) for i in ids]
        # each way to make a piece of two symbols (pieces or single characters): the symbols' numbers, the piece, best score first
        self.first = len(self.names)  # a character that is no piece has its code point after the pieces
        number = lambda x: self.ids.get(x, self.first + ord(x) if len(x) == 1 else None)
        made = [(a, b, i) for x, i in self.ids.items() for k in range(1, len(x)) if (a := number(x[:k])) is not None and (b := number(x[k:])) is not None]
        pairs = np.array(made, dtype=np.int64).reshape(-1, 3)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(key)
        self.pair_key, self.pair_piece = key[order], pairs[order, 2]
        rank = np.argsort(np.argsort([-sp.get_score(i) for i in ids], kind="stable"), kind="stable")
        self.rank = np.append(rank, NEVER).astype(np.int32)  # the last stands for no piece
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.first
        for x, i in self.ids.items():
            if len(x) == 1:
                self.symbol[ord(x)] = i
        self.joined = {pair for piece in self.ids for pair in zip(piece, piece[1:], strict=False)}
        # characters that stand beside another in a piece have a kind each, the others share kind 0
        beside = sorted({x for pair in self.joined for x in pair})
        number = {x: k + 1 for k, x in enumerate(beside)}
        self.kind = np.zeros(0x110000, dtype=np.int32)
        self.kind[[ord(x) for x in beside]] = np.arange(1, len(beside) + 1)
        self.kinds = len(beside) + 1
        self.together = np.sort(np.array([number[a] * self.kinds + number[b] for a, b in self.joined], dtype=np.int64))
        self.is_together = np.zeros(self.kinds**2, dtype=bool) if self.kinds <= 5000 else None
        if self.is_together is not None:
            self.is_together[self.together] = True
        # stands between parts that are checked together
        self.between = next(x for x in chain("\n", map(chr, range(0xE000, 0xF900))) if x not in number)
        self.csv: dict[str, str] = {}
        self.earlier: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # decoded text of parts that don't come back as they were
        self.parts: dict[str, list[int]] = {}

    def merge(self, symbols: str) -> list[int]:
        """Ids of a chunk, by the agenda."""
        score, n = self.score, len(symbols)
        if n == 1:
            parts = [symbols]
        else:
            text = list(symbols)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = [(-score[p], k, p) for k in range(n - 1) if (p := symbols[k : k + 2]) in score]
            heapq.heapify(agenda)
            while agenda:
                _, left, piece = heapq.heappop(agenda)
                right = after[left]
                if not text[left] or right >= n or len(text[left]) + len(text[right]) != len(piece) or text[left] + text[right] != piece:
                    continue
                text[left], text[right] = piece, ""
                nxt = after[left] = after[right]
                if nxt < n:
                    before[nxt] = left
                    if (p := piece + text[nxt]) in score:
                        heapq.heappush(agenda, (-score[p], left, p))
                if (prev := before[left]) >= 0 and (p := text[prev] + piece) in score:
                    heapq.heappush(agenda, (-score[p], prev, p))
            parts = [x for x in text if x]
        out: list[int] = []
        for x in parts:
            if x in self.ids:
                out.append(self.ids[x])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in x.encode())
            else:
                out.append(self.unknown)
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of text between two places where nothing can be merged by rule of its white space."""
        out: list[int] = []
        at = 0
        if len(self.parts) > CACHE:
            self.parts.clear()
        for k in range(1, len(chunk) + 1):
            if k == len(chunk) or (chunk[k - 1], chunk[k]) not in self.joined:
                part = chunk[at:k]
                if (ids := self.parts.get(part)) is None:
                    ids = self.merge(part)
                    if len(part) <= 32 and len(self.parts) <= CACHE:
                        self.parts[part] = ids
                out += ids
                at = k
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the library gives them."""
        return self.chunk_ids(SPACE + text.replace(" ", SPACE)) if text else []

    def pieces_text(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw = bytearray()
            out.append(self.text_of.get(i, ""))
        return "".join(out) + raw.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces in a row, byte pieces as UTF-8, without the space put before the text."""
        return self.pieces_text(ids).removeprefix(" ")

    def pair_pieces(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_piece[at], -1)

    def merge_all(self, parts: list[str]) -> list[list[int]]:
        """merge() of many parts: the agendas of those of one length advance together, a best pair of each at a time."""
        if not len(self.pair_key):
            return [self.merge(x) for x in parts]
        out: list[list[int]] = [[] for _ in parts]
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        for wide in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == wide)
            code = np.frombuffer("".join([parts[k] for k in rows.tolist()]).encode("utf-32-le"), dtype="<u4").reshape(len(rows), wide)
            symbols = self.symbol[code]
            made = self.pair_pieces(symbols[:, :-1], symbols[:, 1:])
            rank = self.rank[made]
            while len(rows):
                n = symbols.shape[1]
                if n > 1:
                    best = rank.argmin(axis=1)  # the leftmost of equal ones
                    go = rank[np.arange(len(rows)), best] < NEVER
                else:
                    go = np.zeros(len(rows), dtype=bool)
                if not go.all():
                    for k, x in zip(rows[~go].tolist(), symbols[~go].tolist(), strict=True):
                        out[k] = x
                    if n == 1 or not go.any():
                        break
                    rows, symbols, made, rank, best = rows[go], symbols[go], made[go], rank[go], best[go]
                each = np.arange(len(rows))
                symbols[each, best] = made[each, best]
                # the right symbol of the merged pair goes, and so does the pair's place
                stays = np.ones(symbols.shape, dtype=bool)
                stays[each, best + 1] = False
                symbols = symbols[stays].reshape(len(rows), n - 1)
                stays = np.ones(made.shape, dtype=bool)
                stays[each, best] = False
                made, rank = made[stays].reshape(len(rows), n - 2), rank[stays].reshape(len(rows), n - 2)
                for at in (best - 1, best):  # the pairs on both sides of the new symbol
                    there = np.flatnonzero((at >= 0) & (at < n - 2))
                    k = at[there]
                    made[there, k] = found = self.pair_pieces(symbols[there, k], symbols[there, k + 1])
                    rank[there, k] = self.rank[found]
        first = self.first
        for k, x in enumerate(out):
            if max(x) >= first:
                out[k] = [i for y in x for i in ([y] if y < first else [self.byte_ids[b] for b in chr(y - first).encode()] if self.byte_ids else [self.unknown])]
        return out

    def compare(self, parts: list[str], ids: list[list[int]], back: list[str]) -> None:
        """ValueError unless the library gives these ids and texts of the parts, put side by side with a character between them that joins none."""
        x = self.between
        between, head = self.merge(x), self.merge(SPACE)
        for k in range(0, len(parts), CHECKED_TOGETHER):
            own = list(head)
            for found in ids[k : k + CHECKED_TOGETHER]:
                own += between
                own += found
            text = x + x.join(parts[k : k + CHECKED_TOGETHER])
            decoded = " " + self.pieces_text(between) + self.pieces_text(between).join(back[k : k + CHECKED_TOGETHER])
            if own != self.library.encode(text) or self.library.decode(own) != decoded.removeprefix(" "):
                raise ValueError(f"the agenda and the library differ on parts of {text[:200]!r}")

    def learn(self, parts: set[str]) -> list[str]:
        """Ids and decoded texts of parts, from those kept earlier or anew; returns the parts that are too long to be kept for good."""
        again = parts & self.earlier.keys()
        self.csv.update((w, self.earlier[w]) for w in again)
        parts = parts - again
        short = [w for w in parts if len(w) < WIDEST]
        long = [w for w in parts if len(w) >= WIDEST]
        own = short + long
        ids = self.merge_all(short) + [self.merge(w) for w in long]
        texts, back = self.quick, []
        for x in ids:
            try:
                back.append("".join([texts[i] for i in x]))
            except KeyError:
                back.append(self.pieces_text(x))
        if self.check:
            self.compare(own, ids, back)
        names = self.names.__getitem__
        self.csv.update((w, ",".join(map(names, x))) for w, x in zip(own, ids, strict=True))
        self.odd.update((w, t) for w, t in zip(own, back, strict=True) if t != w.replace(SPACE, " "))
        return long

    def cut(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The parts of all texts in a row, and how many there are up to the end of each text."""
        whole = "".join([SPACE + t.replace(" ", SPACE) for t in texts if t])
        stops = np.cumsum([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        apart = np.ones(len(whole) + 1, dtype=bool)  # before each character, and at the end
        for k in range(0, len(whole), CUT_TOGETHER):
            kind = self.kind[np.frombuffer(whole[k : k + CUT_TOGETHER + 1].encode("utf-32-le"), dtype="<u4")]
            pair = kind[:-1].astype(np.int64) * self.kinds + kind[1:]
            apart[k + 1 : k + 1 + len(pair)] = ~(np.isin(pair, self.together) if self.is_together is None else self.is_together[pair])
        apart[stops] = True
        places = np.flatnonzero(apart)
        at = places.tolist()
        return [whole[a:b] for a, b in pairwise(at)], np.searchsorted(places, stops).tolist()

    def digest(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        parts, limits = self.cut(texts)
        new = set(filterfalse(self.csv.__contains__, parts))
        if len(self.csv) + len(new) > CACHE // 2:
            self.earlier, self.csv = self.csv, {}
            self.odd = {w: t for w, t in self.odd.items() if w in self.earlier}
            new = set(parts)
        long = self.learn(new)
        csv, odd, out, low = self.csv.__getitem__, self.odd, [], 0
        for text, high in zip(texts, limits, strict=True):
            own = parts[low:high]
            low = high
            joined = ",".join(map(csv, own))
            if not odd or odd.keys().isdisjoint(own):
                decoded = text.replace(SPACE, " ")
            else:
                decoded = "".join([odd.get(w) or w.replace(SPACE, " ") for w in own]).removeprefix(" ")
            out.append((joined.count(",") + 1 if joined else 0, joined, decoded))
        for w in long:
            self.csv.pop(w, None)
            self.odd.pop(w, None)
        return out


@lru_cache(maxsize=2)
def codec(path: str, check: bool) -> PieceCodec:
    return PieceCodec(path, check)


def encode(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """doc_id, ids (array of int) and decoded (text) of every whole text, without begin or end ids.

    Null text counts as empty: no ids, empty text. Repeated rows give repeated rows; an empty table gives none; further
    columns of docs are not read. check: compare with the sentencepiece library; a difference is a ValueError that ends the job.
    """

    def make():
        c = codec(model_path, check)

        def work(batch: pa.RecordBatch) -> list:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [c.encode(t) for t in texts]
            if check and (theirs := c.library.encode(texts, num_threads=1)) != ids:
                k = next(k for k, (x, y) in enumerate(zip(ids, theirs, strict=True)) if x != y)
                raise ValueError(f"the agenda and the library differ on {texts[k][:80]!r}")
            return [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())]

        return work

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrow_map(make, ["doc_id", "ids", "decoded"]), "doc_id long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 of every whole text; other cases as in encode()."""

    def make():
        c = codec(model_path, check)

        def work(batch: pa.RecordBatch) -> list:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids, decoded = [], [], []
            for a, b in slices(texts):
                for count, joined, text in c.digest(texts[a:b]):
                    n.append(count)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
            return [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

        return work

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrow_map(make, names), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
