"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow with a token target. Its documents are put in a random but
fixed order; a document's virtual finish time is the source's cumulative tokens up
to and including it, divided by the source's target. Sorted by that time over all
sources, any prefix of the stream holds the sources in the ratio of their targets;
the mix is the prefix that fits the total budget. A second and later pass over a
source goes on where the pass before ended.

Neither a source nor the stream is ever ordered in one task: both orders are cut
into ranges (of the order hash within a source, of virtual time over the stream),
whose token sums are added up first, so each range is ordered by itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import as_columns, as_rows, field, n_words, saved

#: Documents of a range of a source's order or of the stretch of virtual time that holds the cut, about, at most.
RANGE_ROWS = 250_000
#: Stretches that an interval of virtual time is cut into at once.
TIME_STEPS = 1024


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share_num: int = 3, share_den: int = 2, passes: int = 2) -> DataFrame:
    """Token target of each source from (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating. They share
    share_num / share_den of all tokens by weight; a target stops at ``passes``
    times its source's size and the excess goes to the others by weight. With the
    sources in the order of size / weight the stopped ones are a prefix, so the
    fixed point is found by running sums. Everything up to the one division is
    integer arithmetic. One row per source: the window over them is that small.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    by_fill = W.orderBy((F.col("cap") / F.col("weight")), "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * passes)
    t = t.withColumns({"total": F.sum("source_size").over(every), "w_all": F.sum("weight").over(every), "cap_before": F.coalesce(F.sum("cap").over(by_fill), F.lit(0)), "w_before": F.coalesce(F.sum("weight").over(by_fill), F.lit(0))})
    t = t.withColumn("level", (share_num * F.col("total") - share_den * F.col("cap_before")) / (share_den * (F.col("w_all") - F.col("w_before"))))
    t = t.withColumn("stopped", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"]
    t = t.withColumn("target", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    return t.select("source", "rank", "weight", "source_size", "target")


def queue(docs: DataFrame, key: str = "doc_id", weights: Sequence[int] = (3, 1, 2), share_num: int = 3, share_den: int = 2, passes: int = 2) -> DataFrame:
    """How often the mix takes each document.

    docs needs (key, source, size). Returns those columns with source_size, target,
    finish (virtual finish time in the first pass; null if the target is 0) and
    copies (0 to ``passes``). Rows that agree in key, source and size are
    interchangeable, so reruns agree. Documents without words are never taken. A
    null source is a source; an empty table gives no rows.
    """
    slim = docs.select(F.col(key).alias("_k"), F.col("source"), F.col("size").cast("long").alias("size"))
    slim = saved(slim.withColumn("_h", F.md5(F.coalesce(F.col("_k").cast("string"), F.lit("")))), "mix")
    digits = max(2, math.ceil(math.log(max(1, slim.count()) / RANGE_ROWS, 16)))  # of the order hash, that name a range
    slim = slim.withColumn("_r", F.substring("_h", 1, digits))
    ranges = saved(slim.groupBy("source", "_r").agg(F.sum("size").alias("_n")), "mix-ranges")
    sizes = ranges.groupBy("source").agg(F.sum("_n").alias("source_size"))
    goal = targets(sizes, weights, share_num, share_den, passes)
    before = W.partitionBy("source").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranges = ranges.withColumnRenamed("source", "_s").join(goal.withColumnRenamed("source", "_s2"), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2", "_n").withColumnRenamed("_r", "_rr")
    inside = W.partitionBy("source", "_r").orderBy("_h", "_k", "size").rowsBetween(W.unboundedPreceding, 0)
    timed = slim.withColumn("_in", F.sum("size").over(inside))
    timed = timed.join(ranges, (F.col("source").eqNullSafe(F.col("_s"))) & (F.col("_r") == F.col("_rr"))).drop("_s", "_rr")
    timed = timed.withColumn("_cum", F.col("_before") + F.col("_in"))
    timed = saved(timed.select("_k", "source", "size", "source_size", "target", "rank", "_h", "_cum"), "mix-timed")

    again = F.explode(F.array(*[F.lit(i) for i in range(passes)])).alias("_pass")
    copies = timed.where("target > 0 and size > 0").select("*", again).withColumn("_v", (F.col("_cum") + F.col("_pass") * F.col("source_size")) / F.col("target"))
    budget = goal.agg(F.sum("source_size").alias("_total")).select((share_num * F.col("_total") / share_den).alias("_budget")).first()[0]
    before, stop = 0, None
    n, low, high, whole = copies.agg(F.count(F.lit(1)), F.min("_v"), F.max("_v"), F.sum("size")).first()
    # the stretch of virtual time in which the budget runs out, cut again while it is long
    while n and whole > budget:
        if n <= RANGE_ROWS or low == high:
            upto = W.orderBy("_v", "rank", "_h", "_k", "_pass", "size").rowsBetween(W.unboundedPreceding, 0)
            over = copies.withColumn("_all", F.lit(before) + F.sum("size").over(upto)).where(F.col("_all") > budget)
            # the first copy that no longer fits
            stop = over.agg(F.min(F.struct("_v", "rank", "_h", "_k", "_pass", "size")).alias("_stop"))
            break
        step = F.least(F.floor((F.col("_v") - low) * (TIME_STEPS / (high - low))), F.lit(TIME_STEPS - 1))
        steps = copies.groupBy(step.alias("_t")).agg(F.sum("size").alias("_n"))
        steps = steps.withColumn("_upto", F.sum("_n").over(W.orderBy("_t").rowsBetween(W.unboundedPreceding, 0)))  # a row per stretch
        t, upto, size = steps.where(F.lit(before) + F.col("_upto") > budget).orderBy("_t").select("_t", "_upto", "_n").first()
        before += upto - size
        copies = saved(copies.where(step == t), "mix-cut")
        n, low, high = copies.agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).first()
    kind = "struct<_v:double,rank:int,_h:string,_k:" + dict(slim.dtypes)["_k"] + ",_pass:int,size:bigint>"
    timed = timed.join(F.broadcast(saved(stop, "mix-stop")), F.lit(True)) if stop is not None else timed.withColumn("_stop", F.lit(None).cast(kind))
    taken = sum(
        (F.when(F.col("_stop").isNull() | (F.struct(((F.col("_cum") + i * F.col("source_size")) / F.col("target")).alias("_v"), "rank", "_h", "_k", F.lit(i).alias("_pass"), "size") < F.col("_stop")), 1).otherwise(0) for i in range(passes)),
        F.lit(0),
    )
    return timed.select(F.col("_k").alias(key), "source", "size", "source_size", "target", F.when(F.col("target") > 0, F.col("_cum") / F.col("target")).alias("finish"), F.when((F.col("target") > 0) & (F.col("size") > 0), taken).otherwise(0).alias("copies"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as in docs.

    docs needs key, text and source; other columns pass through, whatever their names.
    Rows are told apart by key, source and size; of rows that agree in all three, which are interchangeable to the
    queue, as many go out as it takes, those of the smallest text hash first.
    """
    got = queue(docs.select(key, "source", n_words(F.col(text)).alias("size")), key, **how)
    got = got.groupBy(F.col(key).alias("_mk"), F.col("source").alias("_ms"), F.col("size").alias("_mn")).agg(F.sum("copies").alias("_mc"), F.count(F.lit(1)).alias("_mr"))
    got = saved(got.where("_mc > 0"), "mix-taken")
    repeated = got.where("_mr > 1").limit(1).count() > 0
    got = got.hint("merge")  # as many rows as documents: a plan that is the same at every size
    own_key, own_source, own_text = field(key), field("source"), field(text)
    d = as_rows(docs).withColumn("_n", n_words(own_text))
    out = d.join(got, own_key.eqNullSafe(F.col("_mk")) & own_source.eqNullSafe(F.col("_ms")) & (F.col("_n") == F.col("_mn")))
    copies = F.col("_mc")
    if repeated:
        turn = F.row_number().over(W.partitionBy("_mk", "_ms", "_mn").orderBy(F.xxhash64(own_text)))
        out = out.withColumn("_mt", F.when(F.col("_mr") > 1, turn).otherwise(1))
        copies = F.floor(F.col("_mc") / F.col("_mr")) + F.when(F.col("_mt") <= F.col("_mc") % F.col("_mr"), 1).otherwise(0)
    return as_columns(out.select("_row", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))))), docs)


def query(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, size, source_size, target, taken over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    q = queue(docs)
    return q.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source is null, encode(source)) - 1 as rk from s),
w as (select *, case rk % 3 when 0 then 3 when 1 then 1 else 2 end as weight, source_size * 2 as cap from r),
f as (
  select *, sum(source_size) over () as total, sum(weight) over () as w_all,
         coalesce(sum(cap) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0) as cap_before,
         coalesce(sum(weight) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0) as w_before
  from w),
l as (select *, cast(3 * total - 2 * cap_before as double) / cast(2 * (w_all - w_before) as double) as level from f),
g as (
  select *, case when level * weight >= cap then cast(cap as double)
                 else arg_min(level, {'a': cap / weight, 'b': rk}) filter (where level * weight < cap) over () * weight end as target
  from l),
c as (
  select d.doc_id, d.size, d.h, d.source, g.source_size, g.target, g.rk, g.total,
         sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size rows unbounded preceding) as cum
  from d join g on d.source is not distinct from g.source),
p as (
  select c.*, i as pass, cast(cum + i * source_size as double) / target as v
  from c, (values (0), (1)) as t(i) where target > 0 and size > 0),
o as (
  select *, sum(size) over (order by v, rk, h, doc_id, pass, size rows unbounded preceding) as upto from p),
stop as (select min(upto) as cut from o where upto > 1.5 * total),
k as (select doc_id, source, size, cum, count(*) as copies from o, stop where cut is null or upto < cut group by all)
select c.doc_id, c.size, c.source_size, c.target, cast(coalesce(k.copies, 0) * c.size as bigint) as taken
from c left join k on c.doc_id is not distinct from k.doc_id and c.source is not distinct from k.source and c.size = k.size and c.cum = k.cum
"""
