"""Registered queries and stages on odd tables: nulls, repeated rows, empty and long texts, clashing names, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import lines, mixing, pieces, registry, simhash
from ledgerlens.llm.common import n_words

CLASH = "_row _n _k _th _drop _parts _new _near_k _near_th _near_n _mk _ms _mn _mc _mr _mt _copy _h _r size node component place total n_tokens ids".split()
LONG = "word " * 40_000
ROWS = [(1, "the same line of text here\nand another one", "en", "a", 5), (2, "the same line of text here\nand another one", "en", None, 5), (3, None, None, "b", None), (4, "", "en", "a", 0), (None, "no key at all in this document", "de", "b", 3), (None, "no key at all in this document", "de", "b", 3), (7, LONG, "en", "a", 200_000), (8, "é ü 漢字 \t x", "fr", "b", 9)]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DDL)
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASH})


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('odd')}"
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def test_op3_op6_op7_op8_queries(spark, folder):
    q = {n.split("_")[0]: f for n, f in registry.queries().items()}
    three = {r.doc_id: r for r in q["op3"](spark, folder).collect() if r.doc_id is not None}
    assert three[3].fingerprint == three[4].fingerprint == "0" * 16 and three[3].component_id == three[4].component_id and three[1].component_id == three[2].component_id
    six = q["op6"](spark, folder).orderBy("start", "n_tokens").collect()
    assert len(six) == 8 and six[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(six, six[1:])) and [r.doc_id for r in six] == [None, None, 1, 2, 3, 4, 7, 8]
    assert {r.doc_id: r.n_tokens for r in six}[3] == 1
    seven = q["op7"](spark, folder).collect()
    assert len(seven) == 8 and all(r.decoded_ok for r in seven) and {r.doc_id: r.n_tokens for r in seven}[4] == 0
    eight = {(r.doc_id, r.n_lines, r.n_kept) for r in q["op8"](spark, folder).collect()}
    assert eight == {(None, 1, 1), (1, 2, 2), (2, 2, 0), (3, 0, 0), (4, 1, 0), (7, 1, 1), (8, 1, 1)}


def test_stages_keep_columns_whatever_their_names(spark, docs):
    had = {(r.doc_id, r.text): tuple(r[c] for c in CLASH) for r in docs.collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert got and all(tuple(r[c] for c in CLASH) == had[r.doc_id, r.text] for r in got)
    kept = lines.dedup(docs, words=True, short=True)
    assert kept.columns == docs.columns and sorted(tuple(r[c] for c in CLASH) for r in kept.collect()) == sorted(tuple(r[c] for c in CLASH) for r in docs.collect())
    near = simhash.drop_near_duplicates(docs)
    assert near.columns == docs.columns
    rows = near.collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(False, 0), (True, 1), (True, 3), (True, 7), (True, 8)] and all(tuple(r[c] for c in CLASH) == had[r.doc_id, r.text] for r in rows)


def test_mix_takes_what_its_queue_says(spark, docs):
    q = mixing.queue(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    want = sorted((r.doc_id is not None, r.doc_id or 0) for r in q.collect() for _ in range(r.copies))
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in mixing.mix(docs).collect()) == want


def test_kept_columns_that_are_called_like_results(spark, docs):
    import public_tokenizers

    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "n_tokens", "ids", "text"))
    assert out.columns == ["doc_id", "kept_n_tokens", "kept_ids", "text", "n_tokens", "ids_crc32", "decoded_ok", "ids"]
    r = out.where("doc_id = 8").first()
    assert r.kept_ids == "ids8" and r.kept_n_tokens == "n_tokens8" and len(r.ids) == r.n_tokens and r.decoded_ok


def test_normalizers_that_are_not_honoured_are_refused():
    def model(*fields):
        spec = b"".join(bytes([n << 3, v]) for n, v in fields)
        return b"\x1a" + bytes([len(spec)]) + spec

    assert pieces.load(model((3, 0), (4, 0))) == ([], False)
    for bad in (model((3, 1)), model((4, 1)), model((4, 0), (5, 0))):
        with pytest.raises(ValueError):
            pieces.load(bad)


def test_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    empty = spark.createDataFrame([], DDL)
    empty.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    for name, query in registry.queries().items():
        assert query(spark, path).collect() == [], name
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, path)
        assert out.count() == 0, name

