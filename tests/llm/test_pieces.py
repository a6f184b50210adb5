import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import pieces

RAW = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
TEXTS = ["Hello world", "", " ", "  two  spaces  ", "tabs\tand\nlines\n\n", "▁ a▁b ▁", "中文字 émigré 🙂🙃 x", "the quick brown fox " * 50, "\x00\x01", "a" * 3000]


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram():
    """The same pieces and scores as a unigram model, which the library itself segments by its Viterbi."""
    out = b""
    for number, kind, value in pieces._fields(RAW):
        if number == 2:
            value = b"".join(varint(n << 3 | k) + (varint(v) if k == 0 else (varint(len(v)) if k == 2 else b"") + v) for n, k, v in pieces._fields(value) if n != 3) + varint(3 << 3) + varint(1)
        out += varint(number << 3 | kind) + varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def both():
    model = unigram()
    return pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def score(c, got):
    return sum(c.low if c.pieces[i][2] == pieces.BYTE else c.pieces[i][1] for i in got)


def test_best_score_is_that_of_the_librarys_lattice(both):
    """The library's n-best search is exact; its one-best encoder rounds sums with a piece of score -1e9 and may miss the best."""
    ours, library = both
    for t in ["Hello world", "the", "x the quick brown fox", " spaces  between ", "of thndouha thre thatble", "été à Noël", "rentner vergessen 1234"]:
        best = library.nbest_encode(t, nbest_size=2)[0]
        assert score(ours, ids(ours.encode(t))) == pytest.approx(score(ours, best), abs=1e-6), t


def test_words_one_by_one_equal_the_whole(both):
    ours = both[0]
    for t in TEXTS:
        if t and "▁" not in t:
            assert ids(ours.encode(t)) == ours.viterbi(("▁" + t).replace(" ", "▁"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_of_any_text(text):
    c = pieces._WORKER.setdefault("t", pieces.Pieces(RAW))
    assert c.decode(c.encode(text)) == text


def test_round_trip_of_texts(both):
    for t in TEXTS:
        assert both[0].decode(both[0].encode(t)) == t


def test_table(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])] + [(None, "x"), (0, "Hello world")]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows) and all(r.decoded_ok for r in got)
    assert [r.n_tokens for r in got if r.doc_id == len(TEXTS)] == [0]
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
