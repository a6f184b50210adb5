import hashlib
import zlib

from pyspark.sql import functions as F

from ledgerlens.llm import media

PAGE = """<html><title>T</title><body><p>Before &amp; <b>bold</b></p><script>no()</script><figure><img src="sha256:{a}" alt="x"><figcaption>A caption</figcaption></figure>
<p>Between<img src='sha256:{b}' alt='inline'>after</p><figure><figcaption>Early</figcaption><video src="http://else/v.mp4"></video></figure><p>End"""


def test_order_positions_and_captions():
    got = media.parse(PAGE.format(a="a" * 64, b="b" * 64))
    assert [(x["kind"], x["text"] or x["ref"][:9], x["caption"]) for x in got] == [
        ("text", "T", None), ("text", "Before & bold", None), ("media", "sha256:aa", "A caption"), ("text", "Between", None),
        ("media", "sha256:bb", "inline"), ("text", "after", None), ("media", "http://el", "Early"), ("text", "End", None),
    ]
    assert [x["pos"] for x in got] == list(range(8))
    assert media.parse(None) == media.parse("") == [] and media.parse("<p><<b></figure></figcaption>")


def test_payloads_round_trip(spark):
    texts = [None, "", "a", "ü" * 96, "x" * 192, "y" * 193, "long " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store = docs.select("doc_id", media.encode_image(media.payload(F.col("text"))).alias("media")).withColumn("digest", F.sha2("media", 256))
    got = {r.digest: r for r in media.describe(store).collect()}
    for r in store.collect():
        t = (texts[r.doc_id] or "").encode()
        p = t + b" " * (max(1, -(-len(t) // 192)) * 192 - len(t))
        f = got[r.digest]
        assert media.decode_image(bytes(r.media))[2] == p and f.payload_bytes == len(p)
        assert f.payload_sha256 == hashlib.sha256(p).hexdigest() and f.tail_crc32 == zlib.crc32(p[-16:]) and f.media_sha256 == r.digest
    assert len(got) == len(texts) - 1  # null and empty are one payload


def test_references_resolve_where_they_stand(spark):
    store = spark.createDataFrame([("a",), ("a",)], "text string").select(media.encode_image(media.payload(F.col("text"))).alias("media")).withColumn("digest", F.sha2("media", 256))
    known = store.first().digest
    pages = spark.createDataFrame([(1, PAGE.format(a=known, b="0" * 64), "pos"), (2, None, "kind"), (None, "<p>x", "text")], "page_id long, html string, kind string")
    rows = media.resolve(media.references(media.sequences(pages)), media.describe(store)).collect()
    one = sorted((r for r in rows if r.page_id == 1), key=lambda r: r.pos)
    assert [r.payload_bytes for r in one] == [None, None, 192, None, None, None, None, None] and one[2].caption == "A caption"
    assert {r.page_id: r.pos for r in rows if r.page_id != 1} == {2: None, None: 0}
    assert media.sequences(pages.limit(0)).count() == 0


def test_query_places_the_media_between_the_lines(spark, tmp_path):
    texts = {0: "one", 1: "a\nb\n\nc & <d>\ne", 2: "", 3: None, 4: "x < y\n<p>not a tag</p>", 5: "line\n" * 3000, 6: "one", None: "\n\n"}
    rows = [(k, t, "so<ur>ce" if k == 1 else "s", "en", "f", 1) for k, t in texts.items()] + [(7, "one", None, None, "f", 1)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, feature string, pos int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = media.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    for r in got:
        t = texts.get(r.doc_id, "one") or ""
        lines = t.split("\n")
        raw = t.encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-16:])
        assert r.pos == sum(1 for x in lines[: len(lines) // 2] if x.split())
        assert r.caption == ("so<ur>ce en" if r.doc_id == 1 else None if r.doc_id == 7 else "s en")
