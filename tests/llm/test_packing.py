import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, tokens, segments, loss):
    """Every id in exactly one piece, offsets without gaps, all limits kept; returns the padding."""
    own = Tokenizer.from_file(PATH)
    ids = {d: own.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts.items()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        raw = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert len(raw) == 4 * r.length and zlib.crc32(raw) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids is None or bytes(r.ids) == raw
        pieces[r.doc_id].append((r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    padding = 0
    for got in bins.values():
        at = 0
        for offset, length, _ in sorted(got):
            assert offset == at
            at += length
        assert at <= tokens and len(got) <= segments and sum(x[2] for x in got) <= loss
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return ids, pieces, padding


def test_documents_whole(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = packing.pack(documents, PATH).collect()
    ids, pieces, padding = check(rows, texts, 1024, 64, 1024)
    assert padding == 0 and set(pieces) == set(texts)
    for d, got in pieces.items():
        got.sort()
        assert got[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and sum(n for _, n in got) == len(ids[d])


def test_odd_rows(odd, none):
    rows = packing.pack(odd, PATH, max_tokens=64, max_segments=3, max_loss=20).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    ids, pieces, _ = check(rows, texts, 64, 3, 20)
    for d, got in pieces.items():
        times = 2 if d in (0, 1, 2) else 1
        assert sum(n for _, n in got) == times * len(ids[d])
    assert packing.pack(none, PATH).count() == 0


def test_prompt_tokens_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", 5), (2, "a b c", 100), (3, "x y", None)], "doc_id long, text string, prompt int")
    rows = packing.pack(docs, PATH, max_tokens=8, max_segments=2, max_loss=2, prompt_tokens="prompt").collect()
    loss = defaultdict(int)
    for r in rows:
        loss[r.doc_id] += r.loss_tokens
        assert r.loss_tokens <= 2
    assert dict(loss) == {1: 3, 2: 0, 3: 2}


def test_sequences_hold_the_ids(documents):
    pieces = packing.pack(documents.limit(20), PATH).cache()
    got = packing.sequences(pieces).collect()
    assert sum(r.n_tokens for r in got) == sum(r.length for r in pieces.collect())
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)


def test_ids_are_the_library_s():
    library, own = Tokenizer.from_file(PATH), packing.tokenizer(PATH)

    @settings(max_examples=500, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdreé.,1")), max_size=60))
    def same(text):
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids

    same()
    for i in range(0, 50256, 7):
        text = library.decode([i])
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
