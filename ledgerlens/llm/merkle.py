"""A Merkle manifest of a table: leaves, the trees of its groups, a root over the groups, and a proof for each row.

A row's leaf is the digest of its columns. In each group the leaves, ordered by key,
are hashed in runs of two, level by level, until one node remains; the groups' roots,
ordered by group, go on the same way to the root.

Levels are windows: partitioned by group and parent index, the full frame's ordered
``collect_list`` holds a run, which is the parent's preimage and has each member's
sibling. Only the first row of a run carries the parent on, so parents are there once on
the next level. Up to ``LEVELS`` levels share one shuffle, as their runs lie in one block of
2 ** ``LEVELS`` consecutive nodes; a block's root is a row of the next step's table, which
is that much smaller. Paths then come down by one equi-join a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import ranked, saved, small

#: Levels of a step; a block has 256 nodes.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<sibling:string,first:boolean>>"


def digest(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the columns: each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def step(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes (g, idx, m, hash) with node, the root of the block where the row is a block's first, and path, the block's part.

    m is the group's number of nodes; idx counts them from 0. A level above the group's one node adds nothing.
    """
    x = nodes.withColumns({"_b": F.shiftright("idx", levels), "node": F.col("hash"), "path": F.array().cast(_PATH)})
    for level in range(levels):
        run = W.partitionBy("g", "_b", F.shiftright("idx", level + 1)).orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        x = x.withColumn("_run", F.collect_list("node").over(run))  # nulls, the rows that carry no node, are left out
        first = F.shiftright("idx", level).bitwiseAND(F.lit(1)) == 0
        entry = F.struct(F.get("_run", F.when(first, 1).otherwise(0)).alias("sibling"), first.alias("first"))
        entry = F.when(F.size("_run") == 2, entry).otherwise(F.struct(F.lit(None).cast("string").alias("sibling"), F.lit(True).alias("first")))
        goes_on = F.col("m") > (1 << level)
        parent = F.when(goes_on, F.sha2(F.concat_ws("", "_run"), 256)).otherwise(F.col("node"))
        carries = F.col("idx").bitwiseAND(F.lit((2 << level) - 1)) == 0
        x = x.withColumns({"path": F.when(goes_on, F.concat("path", F.array(entry))).otherwise(F.col("path")), "node": F.when(carries, parent)})
    return x.drop("_run", "_b")


def paths(nodes: DataFrame) -> DataFrame:
    """(g, idx, path, top): the way of each node of (g, idx, m, hash) to its group's last node, top. nodes should be a table."""
    most = nodes.agg(F.max("m")).first()[0] or 1
    steps = []
    while most > 1:
        levels = min(LEVELS, (most - 1).bit_length())
        done = saved(step(nodes, levels), "merkle")
        steps.append((levels, done.select("g", "idx", "path")))
        blocks = done.where(F.col("idx").bitwiseAND(F.lit((1 << levels) - 1)) == 0)
        nodes = blocks.select("g", F.shiftright("idx", levels).alias("idx"), F.ceil(F.col("m") / (1 << levels)).alias("m"), F.col("node").alias("hash"))
        most = -(-most // (1 << levels))
    got = nodes.select("g", "idx", F.array().cast(_PATH).alias("path"), F.col("hash").alias("top"))
    for levels, below in reversed(steps):
        above = small(saved(got, "merkle-path").select(F.col("g").alias("_g"), F.col("idx").alias("_i"), F.col("path").alias("_path"), "top"))
        got = below.join(above, (F.col("g") == F.col("_g")) & (F.shiftright("idx", levels) == F.col("_i")))
        got = got.select("g", "idx", F.concat("path", "_path").alias("path"), "top")
    return got


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def up(h: Column, x: Column) -> Column:
        pair = F.when(x["first"], F.concat(h, x["sibling"])).otherwise(F.concat(x["sibling"], h))
        return F.sha2(F.coalesce(pair, h), 256)

    return F.aggregate(path, leaf, up)


def siblings_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, from leaf to root."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: x["sibling"])), 256)


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs of (key, grp, leaf): the columns of leaves with subroot, root and path (siblings from leaf to root, and whether the row's side comes first).

    Leaves of a group ascend by key, nulls first, rows of one key by leaf, so equal rows share their places in some way;
    groups ascend by UTF-8 bytes, null first. A group may hold any share of the rows. An empty table gives no rows. Columns
    besides these pass through unless their names begin with an underscore or are those of the result.
    """
    x = saved(leaves.withColumn("_g", F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit(""))), "merkle-leaves")
    x = saved(ranked(x, "_g", ("key", "leaf"), "_idx", "_of"), "merkle-ranked")
    own = paths(x.select(F.col("_g").alias("g"), F.col("_idx").alias("idx"), F.col("_of").alias("m"), F.col("leaf").alias("hash")))
    own = saved(own.select(F.col("g").alias("_og"), F.col("idx").alias("_oi"), F.col("path").alias("_own"), F.col("top").alias("subroot")), "merkle-own")
    groups = saved(own.where("_oi = 0").select(F.lit(0).alias("all"), "_og", "subroot"), "merkle-groups")
    placed = saved(ranked(groups, "all", ("_og",), "_gi", "_gm"), "merkle-placed")
    above = paths(placed.select(F.lit("").alias("g"), F.col("_gi").alias("idx"), F.col("_gm").alias("m"), F.col("subroot").alias("hash")))
    above = above.select(F.col("idx").alias("_ai"), F.col("path").alias("_above"), F.col("top").alias("root"))
    above = saved(placed.join(above, F.col("_gi") == F.col("_ai")).select(F.col("_og").alias("_pg"), "_above", "root"), "merkle-above")
    out = x.join(own, (F.col("_g") == F.col("_og")) & (F.col("_idx") == F.col("_oi"))).join(small(above), F.col("_g") == F.col("_pg"))
    return out.select(*leaves.columns, "subroot", "root", F.concat("_own", "_above").alias("path"))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Where 7 divides the checksum of doc_id, n_chars is one higher in the tampered row. A null doc_id isn't tampered with,
    nor is a null n_chars, whose rows verify.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = {c: F.col(c) for c in FIELDS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    changed = F.when(hit & F.col("n_chars").isNotNull(), digest(list({**fields, "n_chars": F.col("n_chars") + 1}.values())))
    leaves = docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("grp"), digest(list(fields.values())).alias("leaf"), changed.alias("tampered"))
    m = manifest(leaves).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return m.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _enc(c: str) -> str:
    return f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"


def _tree(name: str, source: str) -> str:
    """A recursive table of nodes (g, lvl, idx, m, h) over (g, idx, m, h)."""
    return f"""{name} as (
  select g, 0 as lvl, idx, m, h from {source}
  union all
  select g, lvl + 1, idx // 2, (m + 1) // 2, sha256(string_agg(h, '' order by idx)) from {name} where m > 1 group by g, lvl, idx // 2, m)"""


SQL = f"""
with recursive d as (
  select doc_id, coalesce('=' || lang, '') as g, sha256({' || '.join(_enc(c) for c in FIELDS)}) as leaf,
    case when xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ord(c)::bigint)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 7 = 0
      then sha256({' || '.join(_enc('n_chars + 1' if c == 'n_chars' else c) for c in FIELDS)}) end as bad
  from documents),
l as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by g) as m from d),
{_tree('t', '(select g, idx, m, leaf as h from l)')},
s as (select '' as g, g as grp, row_number() over (order by g) - 1 as idx, count(*) over () as m, h from t where m = 1),
{_tree('u', 's')},
steps as (
  select l.g, l.idx, t.lvl, (l.idx >> t.lvl) & 1 as side, b.h as sib from l join t on t.g = l.g and t.m > 1 and t.idx = l.idx >> t.lvl
    left join t b on b.g = t.g and b.lvl = t.lvl and b.idx = xor(t.idx, 1)
  union all
  select l.g, l.idx, 1000 + u.lvl, (s.idx >> u.lvl) & 1, b.h from l join s on s.grp = l.g join u on u.m > 1 and u.idx = s.idx >> u.lvl
    left join u b on b.lvl = u.lvl and b.idx = xor(u.idx, 1)),
w as (select *, row_number() over (partition by g, idx order by lvl) as k, count(*) over (partition by g, idx) as n from steps),
p as (select g, idx, sha256(coalesce(string_agg(sib, '' order by k), '')) as proof_sha256, max(n) as n from w group by g, idx),
f as (
  select g, idx, 0 as k, coalesce(bad, leaf) as h from l
  union all
  select f.g, f.idx, f.k + 1, sha256(case when w.sib is null then f.h when w.side = 0 then f.h || w.sib else w.sib || f.h end)
  from f join w on w.g = f.g and w.idx = f.idx and w.k = f.k + 1)
select l.doc_id, l.leaf, s.h as subroot, r.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from l join s on s.grp = l.g join u r on r.m = 1 left join p on p.g = l.g and p.idx = l.idx
  join f on f.g = l.g and f.idx = l.idx and f.k = coalesce(p.n, 0)
"""
