"""Shared helpers of the training-data operators: shared-folder tables and graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word, by the contracts of the operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: How many rows a table may have to be broadcast after it was counted (a few MB of narrow rows).
BROADCAST_ROWS = 100_000
#: Rows of a range of ``ranked``, about, at most.
RANGE_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a new folder of this machine, if the master is local; on a cluster it must be set.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='ledgerlens-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to hold at most limit rows; else df, for a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def ranked(df: DataFrame, by: str, order: tuple[str, ...], place: str = "place", total: str = "total") -> DataFrame:
    """df with each row's place (from 0) among the rows of its group ``by`` in the given order, and the group's number of rows.

    No group is ordered in one task: rows are cut into ranges of group and order, a row's place in its range comes from
    the sorted range, and the ranges' counts are added up. Rows that agree in group and order take places among them in
    any way, and a random salt lets ranges part them. df should be a table (``saved``), ``by`` without nulls; nulls come
    first in the order. An empty table stays empty.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    keys = [by, *order, "_salt"]
    x = df.withColumn("_salt", F.rand(7)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_salt")
    x = saved(x.withColumn("_m", F.monotonically_increasing_id()), "ranked")
    x = x.withColumns({"_p": F.shiftrightunsigned("_m", 33), "_at": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m")
    ranges = x.groupBy(F.col(by).alias("__g"), F.col("_p").alias("__q")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = W.partitionBy("__g")
    before = F.coalesce(F.sum("_n").over(own.orderBy("__q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = saved(ranges.select("__g", "__q", (before - F.col("_first")).alias("_base"), F.sum("_n").over(own).alias("_of")), "ranks")
    out = x.join(small(ranges), (F.col(by) == F.col("__g")) & (F.col("_p") == F.col("__q")))
    return out.select(*df.columns, (F.col("_base") + F.col("_at")).alias(place), F.col("_of").alias(total))


def as_rows(docs: DataFrame) -> DataFrame:
    """docs as one struct, _row, so that an operator's own columns can't meet a table's names; ``field`` and ``as_columns`` take it apart."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def field(name: str) -> Column:
    return F.col("_row").getField(name)


def as_columns(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from ``as_rows``, some of them changed."""
    return rows.select(*[changed.get(c, field(c)).alias(c) for c in docs.columns])


def n_words(text: Column) -> Column:
    """The number of words as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected links (a, b) of longs.

    Returns (node, component), component being the smallest node reachable; nodes
    without links don't appear. Large-star and small-star steps alternate until the
    links stop changing, each one a grouped minimum (combined before the shuffle)
    and an equi-join, which adaptive execution splits when a hub is hot. Each step
    is written to the shared folder. Nulls and self-links are ignored.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = saved(
            large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct(),
            "cc",
        )
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
