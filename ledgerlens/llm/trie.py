"""Prefix tries of conversations: which turns they share, and what sharing saves.

A node is a distinct sequence of first turns. Its identity is 128 bits: the running
exclusive-or of hashes of (position, role, text), so equal prefixes of all
conversations meet in one grouped count, combined before the shuffle, and a prefix that
a third of them share is one row afterwards. Nodes, not conversations, are then dealt out
by their prefix at one depth to shards of about ``NODES``. In a shard numpy builds the
level-order trie (LOUDS: a bit vector of node degrees in unary, an array of edge labels)
and rolls counts up from the last level to the first with ``add.at``.

Levels above that depth are few nodes with many below them; there the shards' sums are
merged by grouped sums, a level at a time. The depth grows until no prefix holds more
than ``NODES`` nodes. A shard is ``BAND`` levels deep; deeper conversations go on in shards
of the next band, whose sums come up first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import n_words, ranked, saved, small

#: Nodes of a shard, about; a prefix with more is left to the upper levels.
NODES = 2_000
#: Levels of a shard, and turns of a conversation whose keys are added up by themselves.
BAND = 1_024
#: Conversation ids that are joined to one text before their digest is computed.
PACK = 4_096
#: A conversation borrows up to 3 turns of the first of its 20.
FAMILY, MOST = 20, 4


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, total, label, words): each turn's place in its conversation, however long that is.

    Turns ascend, nulls first; equal turns go by the digest of role and text. Null roles and texts are empty. Rows
    without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    slim = conversations.where("conv_id is not null").select("conv_id", "turn", label.alias("label"), n_words(text).alias("words"))
    return saved(ranked(saved(slim, "turns"), "conv_id", ("turn", "label")).drop("turn"), "turns-placed")


def borrowed(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % MOST


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth from 1, label, words) and conversations (conv_id, length)."""
    convs = placed.where("place = 0").select("conv_id", F.col("total").alias("n"))
    heads = placed.where((F.col("place") < MOST - 1) & (F.col("conv_id") % FAMILY == 0))
    heads = heads.groupBy(F.col("conv_id").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("place", "label", "words"))).alias("_head"))
    c = convs.withColumns({"_b": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": borrowed(F.col("conv_id")).cast("int")})
    c = c.join(heads, F.col("_b") == F.col("_base"), "left")
    given = F.when(F.col("_head").isNotNull() & (F.col("h") > 0), F.slice("_head", F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.expr("slice(_head, 1, 0)"))
    c = saved(c.select("conv_id", "n", "h", F.coalesce(F.size(given), F.lit(0)).alias("shift"), given.alias("given")), "conversations")
    own = placed.join(c.select(F.col("conv_id").alias("_c"), "h", F.greatest("shift", F.lit(0)).alias("shift")), F.col("conv_id") == F.col("_c")).where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("shift") + 1).alias("depth"), "label", "words")
    lent = c.where("shift > 0").select("conv_id", F.explode("given").alias("g")).select("conv_id", (F.col("g.place") + 1).alias("depth"), "g.label", "g.words")
    lengths = c.select("conv_id", (F.greatest("shift", F.lit(0)) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return saved(own.unionByName(lent), "rebuilt"), lengths


def prefixes(rows: DataFrame) -> DataFrame:
    """rows with p1, p2 (the prefix up to the turn) and q1, q2 (the one before), added up by blocks of turns."""
    x = rows.withColumns({"_b": F.floor(F.col("depth") / BAND), "_h1": F.xxhash64("depth", "label"), "_h2": F.xxhash64("label", F.lit("second"), "depth")})
    blocks = x.groupBy(F.col("conv_id").alias("_c"), F.col("_b").alias("_d")).agg(F.bit_xor("_h1").alias("_x1"), F.bit_xor("_h2").alias("_x2"))
    before = W.partitionBy("_c").orderBy("_d").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_c", "_d", F.bit_xor("_x1").over(before).alias("_y1"), F.bit_xor("_x2").over(before).alias("_y2")).where("_d > 0")
    upto = W.partitionBy("conv_id", "_b").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"_r1": F.bit_xor("_h1").over(upto), "_r2": F.bit_xor("_h2").over(upto)})
    x = x.join(blocks, (F.col("conv_id") == F.col("_c")) & (F.col("_b") == F.col("_d")), "left")
    p1, p2 = (F.col(f"_r{i}").bitwiseXOR(F.coalesce(F.col(f"_y{i}"), F.lit(0))) for i in (1, 2))
    x = x.select("conv_id", "depth", "label", "words", p1.alias("p1"), p2.alias("p2"), "_h1", "_h2")
    return x.select("conv_id", "depth", "label", "words", "p1", "p2", F.col("p1").bitwiseXOR(F.col("_h1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("_h2")).alias("q2"))


def nodes_of(paths: DataFrame) -> DataFrame:
    """Distinct prefixes: (depth, p1, p2, q1, q2, label, words, conv_id, n)."""
    return paths.groupBy("depth", "p1", "p2").agg(*[F.min(c).alias(c) for c in ("q1", "q2", "label", "words", "conv_id")], F.count(F.lit(1)).alias("n"))


def ends_of(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(_depth, _p1, _p2, ends_sha256) of nodes at which conversations end.

    Ids are joined to texts of at most ``PACK`` first, so the digest of a prefix at which many conversations end
    is fed from few rows, in order, without holding them.
    """
    last = paths.join(lengths.select(F.col("conv_id").alias("_c"), "length"), (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("length")))
    none = lengths.where("length = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2")])
    ends = last.select("conv_id", F.col("depth").cast("long").alias("depth"), "p1", "p2").unionByName(none)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    packs = ends.groupBy("depth", "p1", "p2", F.floor(F.col("conv_id") / PACK).alias("pack")).agg(ids.alias("ids"))
    packs = packs.repartition("depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "pack")

    def digests(batches):
        key, state = None, None
        for b in batches:
            out = []
            for *k, text in zip(*(b.column(c).to_pylist() for c in ("depth", "p1", "p2", "ids"))):
                if k != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield batch(out)
        if key:
            yield batch([(*key, state.hexdigest())])

    names, kinds = ("_depth", "_p1", "_p2", "ends_sha256"), (pa.int64(), pa.int64(), pa.int64(), pa.string())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))

    return packs.mapInArrow(digests, "_depth long, _p1 long, _p2 long, ends_sha256 string")


class Louds:
    """A level-order unary-degree trie. Node 0 is a root above the tops, node i the target of the i-th one bit."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels
        self.ones, self.zeros = np.flatnonzero(bits), np.flatnonzero(~bits)

    @classmethod
    def of(cls, level: np.ndarray, up: np.ndarray, label: np.ndarray) -> tuple[Louds, np.ndarray]:
        """The trie of nodes with a level, the index of the parent (-1 at tops) and a label, and the nodes' indexes in level order."""
        at = np.zeros(len(level) + 1, np.int64)  # of each index in level order; the last is that of -1
        order, done = [], 1
        by_level = np.argsort(level, kind="stable")
        for nodes in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1) if len(level) else []:
            nodes = nodes[np.lexsort((label[nodes], at[up[nodes]]))]
            at[nodes] = np.arange(done, done + len(nodes))
            done += len(nodes)
            order.append(nodes)
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        degree = np.bincount(at[up[order]], minlength=done)
        bits = np.ones(done + len(order), bool)
        bits[np.cumsum(degree) + np.arange(done)] = False  # a node's ones, then a zero
        return cls(bits, label[order]), order

    def parents(self) -> np.ndarray:
        """The parent of nodes 1, 2, ...: as many zeros as stand before its one."""
        return self.ones - np.arange(len(self.ones))

    def degrees(self) -> np.ndarray:
        return np.diff(self.zeros, prepend=-1) - 1

    def child(self, node: int, label) -> int | None:
        first = self.zeros[node - 1] + 1 if node else 0  # of the node's ones, in the bits
        child = first - node + 1  # ones before it, and one
        for i in range(child, child + int(self.zeros[node] - first)):
            if self.labels[i - 1] == label:
                return i
        return None


def _louds(part: pd.DataFrame) -> tuple[Louds, np.ndarray]:
    own, above = (pd.MultiIndex.from_arrays([part[f"{c}1"], part[f"{c}2"]]) for c in "pq")
    return Louds.of(part["depth"].to_numpy(), own.get_indexer(above), part["label"].to_numpy())


def _rolled(part: pd.DataFrame) -> pd.DataFrame:
    """The shard's nodes with parent, children and subtree sums. Rows may bring sums from the band below."""
    trie, order = _louds(part)
    x = part.iloc[order]
    up, children = trie.parents(), trie.degrees()
    n, below = len(order), x["children"].to_numpy()
    children[1:] += below
    leaves, saving = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    leaves[1:] = x["leaves"].to_numpy() + (children[1:] == 0)
    saving[1:] = x["saving"].to_numpy() + (x["n"].to_numpy() - 1) * x["words"].to_numpy()
    level = x["depth"].to_numpy()
    starts = np.append(np.flatnonzero(np.diff(level, prepend=-1)), n)
    for s, e in zip(starts[-2::-1], starts[:0:-1]):
        for sums in (leaves, saving):
            np.add.at(sums, up[s:e], sums[s + 1 : e + 1])
    conv = np.append(0, x["conv_id"].to_numpy())
    parent = pd.array(conv[up], "Int64")
    parent[up == 0] = pd.NA
    same = {c: x[c].to_numpy() for c in ("depth", "p1", "p2", "q1", "q2", "conv_id", "n")}
    return pd.DataFrame({**same, "parent_conv_id": parent, "children": children[1:], "leaves": leaves[1:], "saving": saving[1:]})[_ROLLED.replace(" long", "").split(", ")]


_ROLLED = "depth long, p1 long, p2 long, q1 long, q2 long, conv_id long, parent_conv_id long, n long, children long, leaves long, saving long"


def _in_shards(nodes: DataFrame, paths: DataFrame, start: int) -> DataFrame:
    """Nodes of the band that begins at a depth, with the prefix t1, t2 that they have there."""
    tops = paths.where(F.col("depth") == start).select(F.col("conv_id").alias("_c"), F.col("p1").alias("t1"), F.col("p2").alias("t2"))
    band = nodes.where((F.col("depth") >= start) & (F.col("depth") < start + BAND))
    return band.join(tops, F.col("conv_id") == F.col("_c")).drop("_c")


def _sums(rolled: DataFrame) -> DataFrame:
    """What the first level of a rolled table gives to its parents."""
    return rolled.groupBy(F.col("q1").alias("_q1"), F.col("q2").alias("_q2")).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saving").alias("saving"))


def _with_sums(nodes: DataFrame, sums: DataFrame | None) -> DataFrame:
    if sums is None:
        return nodes.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saving")})
    x = nodes.join(sums, (F.col("p1") == F.col("_q1")) & (F.col("p2") == F.col("_q2")), "left").drop("_q1", "_q2")
    return x.fillna(0, ["children", "leaves", "saving"])


def shard_depth(nodes: DataFrame, paths: DataFrame, limit: int = NODES) -> int:
    """The least depth at which no prefix has more than so many nodes below it in its band."""
    depth = 1
    while True:
        most = _in_shards(nodes, paths, depth).groupBy("t1", "t2").count().agg(F.max("count")).first()[0]
        if (most or 0) <= limit:
            return depth
        depth += 1


def _buckets(band: DataFrame, limit: int) -> DataFrame:
    n = max(1, -(-band.count() // limit))
    return band.withColumn("bucket", F.pmod(F.xxhash64("t1", "t2"), F.lit(n)).cast("int"))


def tries(conversations: DataFrame, limit: int = NODES) -> DataFrame:
    """The stored form: (start, bucket, n, bits, labels) of each shard of every band.

    ``bits`` is the packed bit vector of ``Louds``, ``labels`` its digests of role and text, joined. Depths above the first
    start are the upper levels, as one shard a depth with the nodes' own labels.
    """
    paths, nodes, _ = _prepared(conversations)
    first, deepest = shard_depth(nodes, paths, limit), nodes.agg(F.max("depth")).first()[0] or 0

    def packed(key, part: pd.DataFrame) -> pd.DataFrame:
        trie, _ = _louds(part)
        return pd.DataFrame([(*key, len(trie.labels), np.packbits(trie.bits).tobytes(), "".join(trie.labels))], columns=["start", "bucket", "n", "bits", "labels"])

    upper = nodes.where(F.col("depth") < first).withColumns({"start": F.col("depth"), "bucket": F.pmod(F.xxhash64("q1", "q2"), F.lit(1 << 20)).cast("int")})
    bands = [_buckets(_in_shards(nodes, paths, s), limit).drop("t1", "t2").withColumn("start", F.lit(s).cast("long")) for s in range(first, deepest + 1, BAND)]
    every = upper
    for b in bands:
        every = every.unionByName(b)
    return every.groupBy("start", "bucket").applyInPandas(packed, "start long, bucket int, n long, bits binary, labels string")


def _prepared(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, lengths = rebuilt(turns(conversations))
    paths = saved(prefixes(rows), "prefixes")
    return paths, saved(nodes_of(paths), "nodes"), lengths


def nodes_report(conversations: DataFrame, limit: int = NODES) -> DataFrame:
    """A row per node of the trie of rebuilt conversations, by the contract of the query.

    conversations needs conv_id (integer), turn, role and text; other columns are not read. No conversation may hold a
    share of the turns that matters: long ones are numbered by ranges, added up by blocks and cut into bands (a round
    of jobs for each ``BAND`` turns). An empty table has no nodes, not even a root.
    """
    paths, nodes, lengths = _prepared(conversations)
    ends = saved(ends_of(paths, lengths), "ends")
    first, deepest = shard_depth(nodes, paths, limit), nodes.agg(F.max("depth")).first()[0] or 0
    zero = lambda c: F.lit(0).cast("long").alias(c)
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).where("n > 0")
    root = root.select(*map(zero, ("depth", "p1", "p2", "q1", "q2")), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n")
    root, done, below = saved(root, "root"), [], None
    for start in reversed(range(first, deepest + 1, BAND)):
        band = _with_sums(_buckets(_in_shards(nodes, paths, start), limit).drop("t1", "t2"), below)
        rolled = saved(band.groupBy("bucket").applyInPandas(_rolled, _ROLLED), "rolled")
        below = saved(_sums(rolled.where(F.col("depth") == start)), "sums")
        done.append(_with_parent(rolled, nodes, root, start))
    for depth in reversed(range(1, first)):
        level = _with_sums(nodes.where(F.col("depth") == depth), below)
        level = level.withColumns({"leaves": F.col("leaves") + (F.col("children") == 0).cast("long"), "saving": F.col("saving") + (F.col("n") - 1) * F.col("words")})
        level = saved(level.withColumn("parent_conv_id", F.lit(None).cast("long")).select("depth", "p1", "p2", "q1", "q2", "conv_id", "parent_conv_id", "n", "children", "leaves", "saving"), "level")
        below = saved(_sums(level), "sums")
        done.append(_with_parent(level, nodes, root, depth))
    root = _with_sums(root, below).withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("long"))
    every = root
    for d in done:
        every = every.unionByName(d)
    out = every.join(ends, (F.col("depth") == F.col("_depth")) & (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2")), "left")
    names = {"n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saving": "saved_tokens"}
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", *[F.col(c).alias(n) for c, n in names.items()], F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def _with_parent(rolled: DataFrame, nodes: DataFrame, root: DataFrame, depth: int) -> DataFrame:
    """rolled with the parents of its first level: the smallest conversation of the node above."""
    above = (root if depth == 1 else nodes.where(F.col("depth") == depth - 1)).select(F.col("p1").alias("_a1"), F.col("p2").alias("_a2"), F.col("conv_id").alias("_parent"))
    tops = rolled.where(F.col("depth") == depth).join(small(above), (F.col("q1") == F.col("_a1")) & (F.col("q2") == F.col("_a2")))
    tops = tops.withColumn("parent_conv_id", F.col("_parent")).select(rolled.columns)
    return rolled.where(F.col("depth") > depth).unionByName(tops)


def query(spark, sf_dir: str) -> DataFrame:
    """Contract: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return nodes_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
