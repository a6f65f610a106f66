import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pointweave.llm import piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = piece_codec.PieceCodec(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t▁abeinrst.,'é")), max_size=60))
def test_like_the_library(text):
    ids = LIBRARY.encode(text)
    assert CODEC.encode(text) == ids and CODEC.decode(ids) == LIBRARY.decode(ids)
    assert CODEC.digest([text]) == [(len(ids), ",".join(map(str, ids)), LIBRARY.decode(ids))]


def expected(text):
    ids = LIBRARY.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_documents(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = piece_codec.encode_digest(documents, PATH).collect()
    assert len(got) == len(texts) and all(tuple(r)[1:] == expected(texts[r.doc_id]) for r in got)


def test_odd_rows(odd, none):
    texts = {r.doc_id: r.text for r in odd.collect()}
    got = piece_codec.encode_digest(odd, PATH).collect()
    assert len(got) == odd.count() and all(tuple(r)[1:] == expected(texts[r.doc_id]) for r in got)
    for r in piece_codec.encode(odd, PATH).collect():
        assert r.ids == LIBRARY.encode(texts[r.doc_id] or "") and r.decoded == LIBRARY.decode(r.ids)
    assert piece_codec.encode_digest(none, PATH).count() == piece_codec.encode(none, PATH).count() == 0


def test_words_are_learned_without_their_marks():
    """What stands beside marks and line breaks that it can't be merged with is learned once, not once for each of them."""
    codec = piece_codec.PieceCodec(PATH)
    text = " ".join(f"inblehant{mark}" for mark in ("", ".", ",", "###", "&&&", "%%%", ".\ninblehant", "\ninblehant,"))
    ids = LIBRARY.encode(text)
    assert codec.digest([text, text]) == [(len(ids), ",".join(map(str, ids)), text)] * 2
    assert len(codec.csv) <= 8 and not any("t." in part or "\nin" in part for part in codec.csv)


def test_worker_forgets_parts(documents, monkeypatch):
    """A worker whose store starts anew within a few texts, and cuts texts in short ranges, encodes alike."""
    monkeypatch.setattr(piece_codec, "CACHE", 60)
    monkeypatch.setattr(piece_codec, "CUT_TOGETHER", 7, raising=False)
    codec = piece_codec.PieceCodec(PATH)
    texts = ["", *(r.text for r in documents.limit(40).collect()), "", "a▁b  c", "x" * 500, " "]
    for k in range(0, len(texts), 3):
        want = [(len(x), ",".join(map(str, x)), LIBRARY.decode(x)) for x in map(LIBRARY.encode, texts[k : k + 3])]
        assert codec.digest(texts[k : k + 3]) == want
    assert not any(len(part) >= piece_codec.WIDEST for part in codec.csv)


def test_difference_from_the_library_is_an_error():
    codec = piece_codec.PieceCodec(PATH)
    codec.merge_all = lambda parts: [[codec.unknown] for _ in parts]
    with pytest.raises(ValueError):
        codec.digest(["abein abein"])
