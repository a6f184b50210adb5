"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict) of the contract.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
BITS = 15
GRAMS = (3, 4, 5)
#: Probability from which a URL is blocked: above one half, as a wrong block costs a clean page.
LEAST = 0.7
#: Rows of a labelled table that the model is fitted on at most.
FIT_ROWS = 20_000
#: What sites of either kind are about and how they call themselves; ``labelled`` puts names together from them.
BLOCK_WORDS = (
    "casino poker bets betting slots jackpot roulette pills meds pharmacy viagra loans payday credit adult dating cams escorts porn warez cracks keygen "
    "torrents replicas watches handbags backlinks spam clicks popups banners adware trackers prizes lottery giveaway followers likes"
).split()
BLOCK_STYLES = "online free cheap win buy best royal fast instant vip super hot discount bonus extra sale now deals club farm".split()
ALLOW_WORDS = (
    "news library university museum council weather recipes garden history science journal archive school health hospital travel trains books reading "
    "writing letters thinking lectures research students teaching theatre music film photography football chess astronomy mathematics physics biology "
    "chemistry geology languages dictionary encyclopedia software documentation developers data maps climate forests rivers mountains cycling running "
    "heritage charity parliament law courts elections economics farming kitchen weaving pottery painting"
).split()
ALLOW_STYLES = "daily city local open national northern southern public community young modern ancient river harbour village county college summer winter evening".split()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fit_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. Rules of one length: the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for _, (h, p, v) in sorted(enumerate(rules), key=lambda r: (len(r[1][0]) + len(r[1][1]), -r[0])):  # the last one looked at wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block) of the small training table: each word by itself and with some styles before and after it, on like hosts and paths."""
    heads, tails, roots = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org"), ("/", "/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}")
    out = []
    for words, styles, times, y in ((BLOCK_WORDS, BLOCK_STYLES, 5, 1), (ALLOW_WORDS, ALLOW_STYLES, 3, 0)):
        for i, word in enumerate(words):
            for j in range(times):
                style = styles[(7 * i + 3 * j) % len(styles)]
                name = word if j == 0 else f"{style}-{word}" if j % 2 else f"{word}-{style}"
                out.append((f"{heads[(i + j) % 4]}{name}.{tails[(i + 2 * j) % 3]}", roots[(i + 3 * j) % 5].format(1000 + 37 * i + j), y))
    return out


def labelled_table(spark) -> DataFrame:
    """``labelled`` as a table (url, block); a few hundred rows."""
    return spark.createDataFrame([(f"https://{h}{p}", y) for h, p, y in labelled()], "url string, block int")


def hashed(host: str, path: str) -> list[int]:
    """The set of hashed n-grams; host and path have grams of their own."""
    out = set()
    for tag, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            out.update(zlib.crc32(f"{tag}{s[i : i + n]}".encode()) & ((1 << BITS) - 1) for i in range(len(s) - n + 1))
    return list(out)


def fit(rows: Sequence[tuple[str, str, int]], steps: int = 1500, rate: float = 5.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps on the mean log loss; each URL's grams weigh 1 in all by length."""
    x = [np.array(hashed(h, p)) for h, p, _ in rows]
    y = np.array([r[2] for r in rows], float)
    at = np.repeat(np.arange(len(x)), [len(i) for i in x])
    cols = np.concatenate(x)
    scale = np.array([1 / np.sqrt(max(1, len(i))) for i in x])
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        z = np.bincount(at, w[cols], len(x)) * scale + b
        g = (1 / (1 + np.exp(-z)) - y) / len(x)
        w -= rate * (np.bincount(cols, (g * scale)[at], len(w)) + decay * w)
        b -= rate * g.sum()
    return w, b


def fit_table(table: DataFrame, url: str = "url", label: str = "block", rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """``fit`` on a labelled table (url, label 1 to block), on its ``rows`` rows of smallest hash; nulls are left out."""
    host, path = split_url(F.col(url))
    known = table.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(label).cast("int").alias("y"), F.xxhash64(url, F.lit(3)).alias("h"))
    return fit([(r.host, r.path, r.y) for r in known.orderBy("h", "host", "path", "y").limit(rows).collect()])


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, float]:
    return fit(labelled())


def score(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    """Probability that the URL is one to block; without host and path there are no n-grams, and the bias alone counts."""
    i = hashed(host, path)
    return float(1 / (1 + np.exp(-(weights[i].sum() / np.sqrt(max(1, len(i))) + bias))))


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES, fitted: tuple[np.ndarray, float] | None = None, least: float = LEAST) -> DataFrame:
    """(key, host, path, rule, verdict, p_block) for every row; the regression judges what no rule fits: block from a probability of ``least``.

    A null or empty url, or one without ``://``, has an empty host and path and the model's bias as its answer; every row
    has one, whatever its key. A narrow pass: nothing is shuffled, so a host with a third of the rows costs no more than others.
    """
    weights, bias = fitted or model()
    kind = dict(pages.dtypes)[key]
    host, path = split_url(F.col(url))
    split = pages.select(F.col(key).alias("_k"), host.alias("host"), path.alias("path"))
    split = split.withColumn("_r", fit_rule(F.col("host"), F.col("path"), rules)).select("_k", "host", "path", "_r.rule", "_r.verdict")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [score(h, q, weights, bias) for h, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            verdict = [v or ("block" if x >= least else "allow") for v, x in zip(b.column(4).to_pylist(), p)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(verdict, pa.string()), pa.array(p)], [key, "host", "path", "rule", "verdict", "p_block"])

    return split.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, p_block double")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract: page_id, host, path, rule, verdict for every page, by a model fitted on the small labelled table."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), fitted=fit_table(labelled_table(spark)))
