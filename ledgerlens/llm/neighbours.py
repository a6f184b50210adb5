"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees' split planes are fitted on a bounded sample (``SAMPLE`` distinct
vectors, the smallest by hash), but every vector is indexed: it goes to its leaf in
each tree. A query walks all trees through one priority queue ordered by how far it
is on the wrong side of the planes passed, and takes leaves until they hold the
share of the index that reached ``RECALL`` on held-back sample queries against
brute force. Queries and vectors meet by leaf; exact cosines rank the leaf's
vectors, and only each query's best leave the task.

Equal vectors keep their ``k`` + 1 smallest ids in the index: no query can have
more of them among its ``k`` nearest, so nothing is lost to a vector that a third
of the rows share. The forest is at most a few MB, whatever the table's size; leaves,
which grow with the table then, are cut into slices that pass by different tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved

SAMPLE = 20_000
TREES = 6
#: Vectors wanted in a leaf; and the sample's vectors that it holds at least.
LEAF, LEAF_SAMPLE = 1024, 16
RECALL = 0.96
#: Queries held by a task at once, and vectors of a leaf that pass by one task, about: a larger leaf is cut into slices.
QUERIES, SLICE = 20_000, 50_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Planes of a binary tree: normal, offset, children; a negative child ~i is leaf i."""

    def __init__(self, x: np.ndarray, cap: int, rng: np.random.Generator):
        self.normals, self.offsets, self.children, self.sizes = [], [], [], []
        self.root = self._grow(x, np.arange(len(x)), cap, rng)
        self.normals = np.array(self.normals).reshape(len(self.offsets), x.shape[1])
        self.offsets, self.children, self.sizes = np.array(self.offsets), np.array(self.children, int).reshape(-1, 2), np.array(self.sizes)

    def _grow(self, x, idx, cap, rng) -> int:
        if len(idx) > cap:
            a, b = x[rng.choice(idx, 2, replace=False)]
            for _ in range(3):  # a few steps of two means make the plane follow the data
                p = x[idx] @ (a - b)
                m = np.median(p)
                up = p > m
                if not up.any():
                    break
                a, b = x[idx[up]].mean(axis=0), x[idx[~up]].mean(axis=0)
            w = (a - b) / max(np.linalg.norm(a - b), 1e-300)
            p = x[idx] @ w
            m = np.median(p)
            up = p > m
            if up.any():
                at = len(self.offsets)
                self.normals.append(w)
                self.offsets.append(m)
                self.children.append((0, 0))
                self.children[at] = (self._grow(x, idx[~up], cap, rng), self._grow(x, idx[up], cap, rng))
                return at
        self.sizes.append(len(idx))
        return ~(len(self.sizes) - 1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            up = (x[inner] * self.normals[node]).sum(axis=1) > self.offsets[node]
            at[inner] = self.children[node, up.astype(int)]
        return ~at


class Forest:
    def __init__(self, sample: np.ndarray, n: int, k: int, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        x = _unit(sample.astype(np.float64))
        cap = max(LEAF_SAMPLE, -(-LEAF * len(x) // max(n, 1)))
        self.trees = [Tree(x, cap, rng) for _ in range(trees)]
        self.bases = np.cumsum([0, *[len(t.sizes) for t in self.trees]])
        self.share = self._calibrated(x, k, rng)

    def order(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """Leaves (number over all trees, size in the sample) of a unit vector, by one queue over all trees."""
        sides = [(t.normals @ q - t.offsets).tolist() if len(t.offsets) else [] for t in self.trees]
        queue = [(0.0, i, t.root) for i, t in enumerate(self.trees)]
        while queue:
            far, i, node = heapq.heappop(queue)
            tree = self.trees[i]
            while node >= 0:
                z = sides[i][node]
                near, other = (1, 0) if z > 0 else (0, 1)
                heapq.heappush(queue, (max(far, abs(z)), i, int(tree.children[node, other])))
                node = int(tree.children[node, near])
            yield int(self.bases[i]) + ~node, int(tree.sizes[~node])

    def visits(self, q: np.ndarray) -> list[int]:
        """The leaves that a query looks into."""
        out, held, want = [], 0, self.share * sum(int(t.sizes.sum()) for t in self.trees)
        for leaf, size in self.order(q):
            if held >= want and out:
                break
            out.append(leaf)
            held += size
        return out

    def _calibrated(self, x: np.ndarray, k: int, rng, queries: int = 150) -> float:
        """The least share of the index, in steps, that gives the wanted recall on sample queries."""
        if len(x) <= k + 1 or all(len(t.sizes) == 1 for t in self.trees):
            return 1.0
        at = [self.bases[i] + t.leaves(x) for i, t in enumerate(self.trees)]
        picks, total, need = rng.choice(len(x), min(queries, len(x)), replace=False), sum(int(t.sizes.sum()) for t in self.trees), []
        for p in picks:
            s = x @ x[p]
            s[p] = -2
            best = np.argpartition(-s, k)[:k]
            when, held = {}, 0
            for leaf, size in self.order(x[p]):
                held += size
                when[leaf] = held / total
            need += [min(when[a[b]] for a in at) for b in best]
        return float(min(1.0, np.quantile(need, RECALL) * 1.02))


def _valid(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(table: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """The k nearest by cosine of each row that the condition ``queries`` picks: query_id, rank, vec_id, score.

    Candidates are all rows but those with the query's own id. Vectors that are null, zero
    or hold null or non-finite components take no part, nor do those of another
    length than most. Ties go to the smaller id; null ids take no part; an empty
    table gives no rows; with fewer than k candidates all are returned.
    """
    spark = table.sparkSession
    x = table.where(F.col(key).isNotNull() & _valid(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("asks"))
    most = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 1
    x = saved(x.where(F.size("v") == dim), "vectors")
    asks = x.where("asks").select("id", "v").distinct()
    # the smallest ids of each different vector, found without bringing its copies together
    few = lambda df, *by: df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r")
    ids = few(few(x.select("v", "id").distinct().withColumn("s", F.pmod(F.xxhash64("id"), F.lit(64))), "v", "s"), "v")
    one = ids.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    one = saved(one, "vectors-one")
    n, n_asks = one.count(), asks.count()
    if not n or not n_asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = one.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    forest = spark.sparkContext.broadcast(Forest(_matrix(sample, dim), n, k))
    blocks = -(-n_asks // QUERIES)
    slices = -(-n * TREES // (SLICE * int(forest.value.bases[-1])))
    kind = dict(table.dtypes)[vector]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            u = _unit(_matrix(b.column(1), dim)) if b.num_rows else np.zeros((0, dim))
            leaves = np.stack([f.bases[i] + t.leaves(u) for i, t in enumerate(f.trees)], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(leaves), pa.list_(pa.int32()))], ["ids", "v", "leaves"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            u = _unit(_matrix(b.column(1), dim)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f.visits(q) for q in u], pa.list_(pa.int32()))], ["id", "v", "leaves"])

    def best(q, qi, v, ids, held):
        """Merges a chunk of vectors into the held (query row, score, id) of a block of queries."""
        qn, vn = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
        s = (q / qn[:, None]) @ (v / vn[:, None]).T
        s[qi[:, None] == ids[None, :]] = -9
        m = min(k, s.shape[1])
        low = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        r, c = np.nonzero((s >= np.maximum(low, held[1])[:, None] - 1e-9) & (s > -5))
        exact = (q[r] * v[c]).sum(axis=1) / (qn[r] * vn[c])
        r, exact, got = (np.concatenate(x) for x in ((held[0][0], r), (held[0][1], exact), (held[0][2], ids[c])))
        order = np.lexsort((got, -exact, r))
        r, exact, got = r[order], exact[order], got[order]
        fresh = np.r_[np.ones(min(1, len(r)), bool), (r[1:] != r[:-1]) | (got[1:] != got[:-1])]
        r, exact, got = r[fresh], exact[fresh], got[fresh]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        ok = place < k
        low = np.full(len(q), -9.0)
        full = place == k - 1
        low[r[full]] = exact[full]
        return (r[ok], exact[ok], got[ok]), low

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by leaf and block of queries, queries first; gives each leaf's best of each query."""

        def out():
            for _, qi, held in state:
                if held is not None and len(held[0][0]):
                    r, score, got = held[0]
                    yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(got), pa.array(score)], ["query_id", "vec_id", "score"])

        where, state, filled = None, [], False
        for b in batches:
            leaf, block, side = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids, v = b.column(3).to_numpy(zero_copy_only=False), _matrix(b.column(4), dim) if b.num_rows else None
            cuts = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(leaf)]) if b.num_rows else ():
                if where != (leaf[s], block[s]):
                    yield from out()
                    where, state = (leaf[s], block[s]), []
                if side[s] == 0:
                    state += [[v[i : min(e, i + 1000)], ids[i : min(e, i + 1000)], None] for i in range(s, e, 1000)]
                else:
                    for part in state:
                        none = ((np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)), np.full(len(part[0]), -9.0))
                        for i in range(s, e, 2000):
                            part[2] = best(part[0], part[1], v[i : min(e, i + 2000)], ids[i : min(e, i + 2000)], part[2] or none)
        yield from out()

    vectors = one.select("ids", "v").mapInArrow(placed, f"ids array<long>, v {kind}, leaves array<int>")
    vectors = vectors.select(F.explode("leaves").alias("leaf"), "ids", "v").select("leaf", "ids", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    vectors = vectors.withColumn("block", (F.col("block") * slices + F.pmod(F.xxhash64("v", F.lit(5)), F.lit(slices))).cast("int"))
    vectors = vectors.select("leaf", "block", F.lit(1).alias("side"), F.explode("ids").alias("id"), "v")
    looks = asks.mapInArrow(asked, f"id long, v {kind}, leaves array<int>")
    looks = looks.select(F.explode("leaves").alias("leaf"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    looks = looks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("leaf", (F.col("block") * slices + F.col("slice")).cast("int").alias("block"), F.lit(0).alias("side"), "id", "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.unionByName(looks).repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", "side")
    found = rows.mapInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract: the 5 nearest of every row of embeddings whose vec_id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
