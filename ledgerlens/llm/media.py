"""Media columns: interleaved sequences of text and resolved media.

HTML becomes an ordered sequence of text and media-reference structs; a reference
names its payload by digest, and a join on the digest resolves it, so positions and
captions stay with what they belong to. Payloads are stored as binary grey images
(PGM, 8-bit samples), one row each, and stay where they were written: only digests
and what was computed from a payload are shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, saved

#: Samples in a row of the stored image.
WIDTH = 192
ITEM = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
_BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "figure", "figcaption", "blockquote", "pre", "nav", "header", "footer", "body", "title"}
_HIDDEN = {"script", "style", "template", "noscript"}
_MEDIA = {"img", "video", "audio", "source", "embed"}


class _Sequence(HTMLParser):
    """Collects (kind, text, ref, caption) in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.buffer: list[str] = []
        self.hidden = 0
        self.figure: list[list] = []  # open figures: the media items they hold so far
        self.caption: list[str] | None = None

    def flush(self):
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.figure.append([])
        elif tag == "figcaption" and self.figure:
            self.flush()
            self.caption = []
        elif tag in _MEDIA and (src := dict(attrs).get("src")):
            self.flush()
            self.items.append(["media", None, src, dict(attrs).get("alt") or None])
            if self.figure:
                self.figure[-1].append(self.items[-1])
        elif tag in _BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.figure[-1] if self.figure else []:
                item[3] = said or item[3]
            if self.figure:
                self.figure[-1].append(["caption", None, None, said])
        elif tag == "figure" and self.figure:
            held = self.figure.pop()
            said = next((x[3] for x in held if x[0] == "caption"), None)
            for item in held:  # a caption may come before its media
                if item[0] == "media":
                    item[3] = said or item[3]
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.buffer if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """Ordered text and media structs of a page; a null or empty page has none, broken markup doesn't raise."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"pos": i, "kind": k, "text": t, "ref": r, "caption": c} for i, (k, t, r, c) in enumerate(p.items)]


def sequences(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` and ``items``, the page's sequence, for every row of pages; a null or empty page has no items."""
    kinds = dict(pages.select(*keep, html).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([parse(x.as_py()) for x in b.column(b.num_columns - 1)], kind)], [*keep, "items"])

    return pages.select(*keep, html).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", items {ITEM}")


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text, spaces appended up to a positive multiple of the image's width."""
    t = F.coalesce(text, F.lit(""))
    size = F.octet_length(t)
    rows = F.greatest(F.ceil(size / WIDTH).cast("int"), F.lit(1))
    return F.concat(t, F.repeat(F.lit(" "), rows * WIDTH - size)).cast("binary")


def encode_image(samples: Column) -> Column:
    """A binary grey image of WIDTH samples a row; lossless."""
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(samples) / WIDTH).cast("int").cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(head, samples)


def decode_image(media: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a stored image."""
    magic, size, top, samples = media.split(b"\n", 3)
    w, h = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(samples) != w * h:
        raise ValueError("not a binary grey image of 8-bit samples")
    return w, h, samples


def features(media: bytes) -> dict:
    """What a resolved payload carries: sizes, digests and a short visual description."""
    w, h, samples = decode_image(media)
    x = np.frombuffer(samples, np.uint8).reshape(h, w)
    bands = x.reshape(h, 8, w // 8).mean(axis=(0, 2))
    rank = "".join("1" if v else "0" for v in bands[1:] > bands[:-1])
    return {"payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": f"grey {w}x{h} mean={x.mean():.4f} dev={x.std():.4f} rise={rank}"}


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(store: DataFrame, digest: str = "digest", media: str = "media") -> DataFrame:
    """One row (digest, features) for each different payload of a store, read from its stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(x.as_py()) for x in b.column(1)]
            names = [x.split()[0] for x in _FEATURES.split(", ")]
            kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in _FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[n] for g in got], k) for n, k in zip(names, kinds)]], [digest, *names])

    each = store.select(digest, media).mapInArrow(run, f"{digest} string, {_FEATURES}")
    names = [x for x in each.columns if x != digest]
    return each.groupBy(digest).agg(F.min(F.struct(*names)).alias("_f")).select(digest, "_f.*")


#: A digest that this part of all references name, or more, is hot: there are at most as many.
HOT_SHARE = 1000


def references(seqs: DataFrame, scheme: str = "sha256:") -> DataFrame:
    """The items of ``sequences`` as rows, with the digest that a media item refers to (_d; null for others and for foreign references)."""
    keep = [c for c in seqs.columns if c != "items"]
    rows = seqs.select(*keep, F.explode_outer("items").alias("_i")).select(*keep, "_i.*")
    return rows.withColumn("_d", F.when((F.col("kind") == "media") & F.col("ref").startswith(scheme), F.substring("ref", len(scheme) + 1, 64)))


def resolve(items: DataFrame, described: DataFrame) -> DataFrame:
    """``references`` with their payloads' columns; null for text, for dangling and for foreign references.

    items is read more than once, so save it first. Text items are not joined. A digest that a thousandth of all
    references name is joined by broadcast, as there are at most ``HOT_SHARE`` of those; the others are shuffled.
    """
    known, names = described.withColumnRenamed("digest", "_digest"), [c for c in described.columns if c != "digest"]
    uses = items.where("_d is not null").groupBy("_d").agg(F.count(F.lit(1)).alias("_uses"))
    total = uses.agg(F.sum("_uses").alias("_all"))
    hot = saved(uses.join(F.broadcast(total), F.lit(True)).where(F.col("_uses") * HOT_SHARE >= F.col("_all")).select("_d"), "media-hot")
    hot_known = saved(known.join(F.broadcast(hot), F.col("_digest") == F.col("_d")).drop("_d"), "media-hot-payloads")
    other = items.where("_d is null").select("*", *[F.lit(None).cast(k).alias(c) for c, k in described.dtypes if c != "digest"])
    media = items.where("_d is not null")
    few = media.join(F.broadcast(hot), "_d", "left_semi").join(F.broadcast(hot_known), F.col("_d") == F.col("_digest"), "left")
    rest = media.join(F.broadcast(hot), "_d", "left_anti").join(known, F.col("_d") == F.col("_digest"), "left")
    out = [c for c in items.columns if c != "_d"] + names
    return few.select(*out).unionByName(rest.select(*out)).unionByName(other.select(*out))


def _page(text: Column, digest: Column, caption: Column) -> Column:
    """A text as a page: a paragraph for each line, the stored form as a figure with its caption after the first half of the lines."""
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(plain(F.coalesce(text, F.lit(""))), "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    paragraphs = lambda part: F.concat(F.lit("<p>"), F.array_join(part, "</p><p>"), F.lit("</p>"))
    figure = F.concat(F.lit("<figure><img src='sha256:"), digest, F.lit("'><figcaption>"), plain(caption), F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), paragraphs(F.slice(lines, F.lit(1), half)), figure, paragraphs(F.slice(lines, half + 1, F.size(lines))), F.lit("</article>"))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract: the stored form of every text of documents, read back and described; pos is its place between the text's lines.

    Each document becomes a page of its lines with a reference to its stored text among them, and a caption of source and
    language. Every row of documents gives a row, whatever its key; null texts are empty ones.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = docs.select("doc_id", "source", "lang", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), encode_image(payload(F.col("text"))).alias("media"))
    made = made.withColumn("digest", F.sha2("media", 256))
    path = new_path(spark, "media")
    made.select("digest", "media").write.option("compression", "zstd").parquet(path)
    pages = made.select("doc_id", "n_bytes", _page(F.col("text"), F.col("digest"), F.concat_ws(" ", "source", "lang")).alias("html"))
    items = references(sequences(pages, keep=("doc_id", "n_bytes"))).where("kind = 'media'").select("doc_id", "n_bytes", "pos", "caption", "_d")
    got = resolve(saved(items, "media-items"), describe(spark.read.parquet(path)))
    return got.select("doc_id", "n_bytes", *[x.split()[0] for x in _FEATURES.split(", ")], "pos", "caption")
