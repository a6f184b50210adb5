import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, world! it's 42 ÜBER-naïve Σίσυφος", "", None, "a\x1cb c d\x85e", "x <|endoftext|> y<|startoftext|>", "İstanbul ﬁne été ​　 中文字 don't we'll", "word " * 9000, "# ! \" ##", "aͅ Ǆ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_word_encoder_equals_the_library(library):
    enc = tokens.WordEncoder(PATH)
    for t in TEXTS:
        assert np.frombuffer(enc.encode([t or ""])[0], "<u2").tolist() == library.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(library, texts):
    enc = tokens.encoder(PATH)
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_round_trip(spark, library):
    rows = [(i * 7 % 11, t) for i, t in enumerate(TEXTS)] + [(None, "null key"), (3, "same key"), (3, "another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = tokens.write(docs, PATH, length=16)
    got = sorted((tuple(r) for r in tokens.read(files).collect()), key=lambda r: r[1])
    at = 0
    for (key, text), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), got, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert r == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for f in files.collect():
        with tokens._open(f.path + ".arrow") as source:
            reader = tokens.SequenceReader(source)
            assert len(reader) == -(-f.n_tokens // 16)
            ids, mask = reader.sequence(len(reader) - 1)
            assert len(ids) == len(mask) == 16 and sum(mask.to_pylist()) == (f.n_tokens - 1) % 16 + 1
            assert pa.types.is_fixed_size_list(reader.reader.schema.field("mask").type)


def test_empty_table(spark):
    assert tokens.read(tokens.write(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0


MIXED = ["Heat heat, HEAT! heat*** heat$$$ (heat) heat's don't '' 'tis", "Über ÜBER über*** queß... Ñandú ñandú,", "J̌ x ǰ x J̌A İ ı K Å ſ ŉ ΣΑΣ σας ᄀ가 ᾼ", "<|STARTOFTEXT|> <|endoftext|>x a<|endoftext|> b<| |> ...", "a\x00b \x00 \x1c.\x1d a\x85. \xa0.. _a_ a_ a__ 7. x7. x…. …."]


def test_words_of_letters_skip_the_whole_tokenizer(library, monkeypatch):
    """A word of letters goes to the model once, however it is written and whatever punctuation is behind it."""
    enc, seen, whole = tokens.WordEncoder(PATH), [], tokens.WordEncoder._whole
    monkeypatch.setattr(tokens.WordEncoder, "_whole", lambda self, texts: seen.extend(texts) or whole(self, texts))
    texts = [f"{w}{end}" for w in ("heat", "Heat", "HEAT", "über", "Über", "ñandú") for end in ("", ",", "***", "$$$", ".###")]
    got = enc.encode([" ".join(texts), *texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in (" ".join(texts), *texts)]
    assert set(seen) <= {"", ",", "***", "$$$", ".###"}


@pytest.mark.parametrize("kept", [2, 400_000])
def test_mixed_words_in_any_batch(library, monkeypatch, kept):
    monkeypatch.setattr(tokens, "KEPT", kept)
    enc = tokens.WordEncoder(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in MIXED]
    for texts, ids in [(MIXED, want), *(([t], [i]) for t, i in zip(MIXED, want)), (MIXED[::-1], want[::-1]), ([], [])]:
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)] == ids


def test_letters_with_any_mark(library):
    """Each letter below U+1100, alone and with marks that may compose with it, as the library has it."""
    letters = [chr(c) for c in range(1, 0x1100) if chr(c).isalpha()]
    words = [*letters, *(f"x{c}y." for c in letters), *(f"{c}{m}" for c in letters[:52] + ["Σ", "σ", "é"] for m in map(chr, range(0x300, 0x370)))]
    got = tokens.encoder(PATH).encode(words)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]


def test_texts_of_several_blocks(spark, library, monkeypatch):
    rows = [(i, "word " * (i % 7) + f"w{i}") for i in range(60)]
    monkeypatch.setattr(tokens, "AT_ONCE", 64)
    enc, col = tokens.encoder(PATH), pa.array([t for _, t in rows])
    ids, at = enc.encode_array(col.slice(5, 20), (2,))
    assert [ids[s:e].tolist() for s, e in zip(at, at[1:])] == [[*library.encode(t, add_special_tokens=False).ids, 2] for _, t in rows[5:25]]
    got = tokens.read(tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH)).orderBy("doc_id").collect()
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for _, t in rows]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want]
