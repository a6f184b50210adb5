"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has the majority bit, over its shingles' hashes, at each
position. Fingerprints are compared exactly, all against all, in tiles: numpy
exclusive-or and bit counts over a block of at most ``TILE`` fingerprints against
streamed chunks of others. Tile pairs that can't hold a link are never formed:
the population counts of each quarter of a 64-bit fingerprint bound the Hamming
distance from below, as do those of the whole inside a tile; for longer
fingerprints the numbers of shingles bound the similarity from above.

Equal fingerprints are one row before any comparison, so copies cost nothing, and
a tile gives a spanning forest of its links rather than all pairs; both keep every
link between different fingerprints reachable.

``near_duplicates`` takes such links as candidates only: of each connected group of
candidates the sets of shingles meet, again in tiles of bounded size, and a link
stays if its exact Jaccard similarity reaches the bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import as_columns, as_rows, components, field, saved, small

#: Fingerprints of a cell that one task holds; a larger cell is split into blocks.
TILE = 4096
#: Odd constants of the mixing that makes further fingerprint words of a hash (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_digests(text: bytes, k: int) -> tuple[bytes, int]:
    """XXH64 digests (seed 42, big-endian, joined) of the k-word shingles and their number."""
    from xxhash import xxh64_digest as xx

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return b"", 0
    joined = b" ".join(words)
    if n <= k:
        return xx(joined, 42), 1
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[: n - k]]]
    return b"".join([xx(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :])]), n - k + 1


def _ones(rows: np.ndarray) -> np.ndarray:
    """Set bits by position over rows of bytes; sums of 255 rows fit a byte."""
    bits, total = rows.shape[1] * 8, np.zeros(rows.shape[1] * 8, np.int64)
    for at in range(0, len(rows), 255 * 64):
        b = np.unpackbits(rows[at : at + 255 * 64], axis=1)
        full = len(b) // 255 * 255
        if full:
            total += np.add.reduce(b[:full].reshape(-1, 255, bits), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += np.add.reduce(b[full:], axis=0, dtype=np.uint8)
    return total


def _majority(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` unsigned 64-bit words: the bits set in over half of the hashes, further words of hashes mixed from them."""
    more = [h]
    for c in (MIX * words)[: words - 1]:
        x = (more[-1] ^ (more[-1] >> np.uint64(31))) * np.uint64(c)
        more.append(x ^ (x >> np.uint64(29)))
    rows = np.stack(more, axis=1).astype(">u8").view(np.uint8).reshape(len(h), 8 * words)
    return np.packbits(2 * _ones(rows) > len(rows)).view(">u8").astype(np.uint64)


def fingerprint(text: bytes | None, k: int) -> tuple[np.ndarray, int]:
    """One unsigned 64-bit word over all shingles, repeats included, and their number; zero if there are none."""
    digests, n = shingle_digests(text or b"", k)
    if not n:
        return np.zeros(1, np.uint64), 0
    return np.packbits(2 * _ones(np.frombuffer(digests, np.uint8).reshape(n, 8)) > n).view(">u8").astype(np.uint64), n


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The different shingle hashes of a text in ascending order."""
    return np.unique(np.frombuffer(shingle_digests(text or b"", k)[0], ">u8").astype(np.uint64))


def _binary(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, f0 as a long, n_shingles) for each row of docs; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ns = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(_binary(b.column(1))):
                (out[i],), ns[i] = fingerprint(t.as_py(), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64)), pa.array(ns)], [key, "f0", "n_shingles"])

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, f0 long, n_shingles long")


def _edges(radius: int, words: int, least: float):
    """A task's tiles: rows sorted by tile with its own block first; gives links that span what the tile links."""

    def links(left, right, same, label, a, b):
        """label holds, for each row of left, the first row that it is linked to so far."""
        lf, ln, lid, lp, lo = left
        rf, rn, rid, rp, ro = right
        step, at = 64, 0
        while at < len(rid):
            to = min(len(rid), at + step)
            # rows are in the order of population counts, or of shingle numbers for longer fingerprints
            span = (ro[at:to].min() - radius, ro[at:to].max() + radius + 1) if words == 1 else (least * ro[at:to].min() - 1e-9, ro[at:to].max() / least + 1e-9)
            low, high = np.searchsorted(lo, span)
            low = max(low, at) if same else low
            if low < high and lp[low:high].min() - rp[at:to].max() <= radius and rp[at:to].min() - lp[low:high].max() <= radius:
                apart = np.bitwise_count(lf[low:high, :1] ^ rf[at:to, 0]).astype(np.uint16)
                for w in range(1, words):
                    apart += np.bitwise_count(lf[low:high, w : w + 1] ^ rf[at:to, w])
                ii, jj = np.nonzero(apart <= (radius if words == 1 else FEW_RADIUS))
                if words > 1 and len(ii):
                    n, m = ln[low:high][ii], rn[at:to][jj]
                    ok = (apart[ii, jj] <= np.where(np.minimum(n, m) < FEW, FEW_RADIUS, radius)) & (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9)
                    ii, jj = ii[ok], jj[ok]
                ii, jj = ii + low, jj + at
                if same:
                    ii, jj = ii[ii > jj], jj[ii > jj]
                order = np.argsort(jj, kind="stable")
                ii, jj = ii[order], jj[order]
                for i in np.split(ii, np.flatnonzero(np.diff(jj)) + 1) if len(ii) else ():
                    j = jj[0]
                    jj = jj[len(i) :]
                    found = np.unique(label[i])
                    if same and label[j] in found:
                        found = found[found != label[j]]
                    a.extend(lid[found].tolist())
                    b.extend([int(rid[j])] * len(found))
                    if same:
                        found = np.append(found, label[j])
                    if len(found) > 1:
                        label[np.isin(label, found)] = found.min()
            at, step = to, 512

    def block(parts):
        f = np.concatenate([x[0] for x in parts])
        n, p = np.concatenate([x[1] for x in parts]), np.bitwise_count(f).sum(axis=1, dtype=np.int64)
        o = p if words == 1 else n
        order = np.argsort(o, kind="stable")
        return f[order], n[order], np.concatenate([x[2] for x in parts])[order], p[order], o[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, own, ready, label, a, b = None, [], None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            cell, blk, side, node, n = cols[:5]
            f = np.stack(cols[5:], axis=1).view(np.uint64) if words > 1 else np.ascontiguousarray(cols[5]).view(np.uint64).reshape(-1, 1)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(blk) != 0) | (np.diff(side) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(cell)]):
                if tile != (cell[s], blk[s]):
                    if own and ready is None and sum(len(x[2]) for x in own) > 1:
                        alone = block(own)
                        links(alone, alone, True, np.arange(len(alone[2])), a, b)
                    tile, own, ready, label = (cell[s], blk[s]), [], None, None
                part = (f[s:e], n[s:e], node[s:e])
                if side[s] == 0:
                    own.append(part)
                elif own:
                    if ready is None:
                        ready = block(own)
                        label = np.arange(len(ready[2]))
                        links(ready, ready, True, label, a, b)
                    links(ready, block([part]), False, label, a, b)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if own and ready is None and sum(len(x[2]) for x in own) > 1:
            alone = block(own)
            links(alone, alone, True, np.arange(len(alone[2])), a, b)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _quarters(f: Column) -> Column:
    """The population counts of four quarters, each 0 to 16, in base 32."""
    return sum((F.bit_count(F.shiftrightunsigned(f, 16 * q).bitwiseAND(F.lit(0xFFFF))).cast("long") * 32**q for q in range(4)), F.lit(0).cast("long"))


def links(fps: DataFrame, radius: int, words: int = 1, least: float = 0.0, tile: int = TILE) -> DataFrame:
    """Links (a, b) between rows of fps (node, n_shingles, f0 ..) that span all links of at most ``radius`` bits.

    One word: cells are the quarters' population counts, and two cells meet if
    those differ by ``radius`` or less in all. More words: a link needs shingle
    numbers in the ratio ``least`` or nearer too, and cells are bands of that ratio;
    fewer than ``FEW`` shingles are allowed ``FEW_RADIUS`` bits. There are at most 17^4 cells or a few hundred bands, so their table is
    broadcast. Rows with one node must be one row.
    """
    if words == 1:
        cell = _quarters(F.col("f0"))
        deltas = sorted({sum(d * 32**q for q, d in enumerate(ds)) for ds in product(range(-radius, radius + 1), repeat=4) if 0 < sum(map(abs, ds)) <= radius})
        deltas = [d for d in deltas if d < 0]
    else:
        cell = F.when(F.col("n_shingles") > 0, F.floor(F.log(F.col("n_shingles").cast("double")) / -math.log(least) + 1e-9)).otherwise(-9).cast("long")
        deltas = [-1]
    names = [f"f{j}" for j in range(words)]
    x = fps.select(cell.alias("cell"), "node", "n_shingles", *names)
    cells = saved(x.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks")), "simhash-cells")
    x = x.join(F.broadcast(cells), "cell").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    own = F.array(F.struct(F.col("cell").alias("to"), F.col("mine").alias("block"), F.lit(0).alias("side")))
    earlier = F.transform(F.filter(F.sequence(F.lit(0), F.col("mine")), lambda b: b < F.col("mine")), lambda b: F.struct(F.col("cell").alias("to"), b.alias("block"), F.lit(1).alias("side")))
    home = x.withColumn("t", F.explode(F.concat(own, earlier))).select("t.*", "node", "n_shingles", *names)
    there = F.broadcast(cells.select(F.col("cell").alias("to"), F.col("blocks").alias("others")))
    away = x.withColumn("to", F.explode(F.array(*[F.col("cell") + F.lit(d).cast("long") for d in deltas]))).join(there, "to")
    away = away.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select("to", "block", F.lit(1).alias("side"), "node", "n_shingles", *names)
    rows = home.unionByName(away)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "to", "block").sortWithinPartitions("to", "block", "side")
    return rows.mapInArrow(_edges(radius, words, least), "a long, b long")


def groups(fps: DataFrame, key: str = "doc_id", radius: int = 2, tile: int = TILE) -> DataFrame:
    """(key, f0, component): component is the smallest key of all rows reachable by links.

    fps is as from ``fingerprints``; it is read more than once, so save it first. Null
    keys don't count as smallest; a component of null keys only has a null.
    """
    fps = fps.withColumn("node", F.col("f0"))
    one = saved(fps.groupBy("node").agg(F.min(key).alias("low"), F.first("f0").alias("f0"), F.max("n_shingles").alias("n_shingles")), "simhash-one")
    linked = components(links(one, radius, tile=tile))
    where = one.select("node", "low").join(linked, "node")
    low = where.groupBy("component").agg(F.min("low").alias("least"))
    answer = saved(where.join(low, "component").select("node", "least"), "simhash-answer")
    named = one.select("node", "low").join(answer, "node", "left").select("node", F.coalesce("least", "low").alias("component"))
    return fps.join(named, "node").select(key, "f0", "component")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, fingerprint, component_id over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    g = groups(saved(fingerprints(docs), "simhash"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Words of a candidate's fingerprint and how many of the 256 bits may differ. At a Jaccard similarity of 0.8 the expected
#: number is 256 * acos(c) / pi = 38.8 with c = 2 * 0.8 / 1.8, the cosine of two sets of like size, with a deviation of 5.7:
#: the radius lies above it by 4 deviations. A set of 4 of another's 5 shingles is further off (48, deviation 6.2), hence
#: the wider radius for fewer than FEW shingles.
NEAR_WORDS, NEAR_RADIUS, FEW, FEW_RADIUS = 4, 62, 8, 78
#: Shingles that a task holds when it verifies candidates (32 MB with their numbers); a larger group of candidates is split into blocks.
HELD = 2_000_000


def _signatures(docs: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """(_k, _th, node, n_shingles, f0 ..) of each row: key, text hash, a hash of the set of shingles, its size and fingerprint."""
    names = [f"f{j}" for j in range(NEAR_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xx

        for b in batches:
            out, ns, nodes = np.zeros((b.num_rows, NEAR_WORDS), np.uint64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64)
            for i, t in enumerate(_binary(b.column(2))):
                h = shingle_set(t.as_py(), shingle)
                ns[i], nodes[i] = len(h), xx(h.tobytes(), 7)
                if len(h):
                    out[i] = _majority(h, NEAR_WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes.view(np.int64)), pa.array(ns), *[pa.array(out[:, j].view(np.int64)) for j in range(NEAR_WORDS)]], ["_k", "_th", "node", "n_shingles", *names])

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_th"), F.col(text).alias("_t")).mapInArrow(run, f"_k {kind}, _th long, node long, n_shingles long, " + ", ".join(f"{x} long" for x in names))


class _Verified:
    """One block of candidates with their sets; ``against`` links a further set to those that it is similar to."""

    def __init__(self, rows: list[tuple], least: float):
        self.least, self.nodes = least, np.array([r[0] for r in rows], np.int64)
        self.prints, sets = np.stack([r[1] for r in rows]), [r[2] for r in rows]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = np.split(flat, np.cumsum(self.sizes)[:-1])
        self.label, self.mark = np.arange(len(rows)), np.zeros(len(self.known), bool)

    def similar(self, print_: np.ndarray, size: int, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Those of rows whose set has a Jaccard similarity of ``least`` or more to a set; ids are its shingles in ``known``."""
        n = self.sizes[rows]
        few = np.minimum(n, size) < FEW
        near = np.bitwise_count(self.prints[rows] ^ print_).sum(axis=1, dtype=np.int64) <= np.where(few, FEW_RADIUS, NEAR_RADIUS)
        rows = rows[near & (np.minimum(n, size) >= self.least * np.maximum(n, size) - 1e-9)]
        if not len(rows):
            return rows
        self.mark[ids] = True
        both = np.add.reduceat(self.mark[np.concatenate([self.ids[i] for i in rows])], np.r_[0, np.cumsum(self.sizes[rows])[:-1]], dtype=np.int64)
        self.mark[ids] = False
        return rows[both >= self.least * (self.sizes[rows] + size - both) - 1e-9]

    def among(self, a: list, b: list):
        for j in range(len(self.nodes) - 1):
            later = np.flatnonzero(self.label[j + 1 :] != self.label[j]) + j + 1  # sets of one label need no further link
            self._join(self.similar(self.prints[j], int(self.sizes[j]), self.ids[j], later), int(self.nodes[j]), self.label[j], a, b)

    def against(self, node: int, print_: np.ndarray, shingles: np.ndarray, a: list, b: list):
        at = np.searchsorted(self.known, shingles).clip(max=len(self.known) - 1)
        found = self.similar(print_, len(shingles), at[self.known[at] == shingles], np.arange(len(self.nodes)))
        self._join(found, node, None, a, b)

    def _join(self, found: np.ndarray, node: int, own, a: list, b: list):
        labels, first = np.unique(self.label[found], return_index=True)
        a.extend(self.nodes[found[first]].tolist())
        b.extend([node] * len(first))
        if own is not None:
            labels = np.append(labels, own)
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels.min()


def _verify(least: float, shingle: int):
    """Links of the tiles in a task's rows (component, block, side, node, f0 .., text), which are sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, own, ready, a, b = None, [], None, [], []

        def start():
            made = _Verified(own, least)
            made.among(a, b)
            return made

        for batch in batches:
            where = zip(*(batch.column(i).to_pylist() for i in range(3)))
            nodes = batch.column(3).to_pylist()
            prints = np.stack([batch.column(4 + j).to_numpy() for j in range(NEAR_WORDS)], axis=1).view(np.uint64) if batch.num_rows else None
            texts = _binary(batch.column(4 + NEAR_WORDS))
            for i, (component, block, side) in enumerate(where):
                if tile != (component, block):
                    if len(own) > 1 and ready is None:
                        start()
                    tile, own, ready = (component, block), [], None
                shingles = shingle_set(texts[i].as_py(), shingle)
                if side == 0:
                    own.append((nodes[i], prints[i].copy(), shingles))
                elif own:
                    ready = ready or start()
                    ready.against(nodes[i], prints[i], shingles, a, b)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a.clear()
                b.clear()
        if len(own) > 1 and ready is None:
            start()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _similar(docs: DataFrame, one: DataFrame, text: str, key: str, shingle: int, least: float, tile: int, held: int) -> DataFrame:
    """Links (a, b) that span all pairs of sets whose Jaccard similarity is ``least`` or more.

    one has a row (node, n_shingles, f0 .., _k, _th) for each different set. Candidates meet within their connected
    group alone; a group of more than ``held`` shingles or ``tile`` sets is cut into blocks, and pairs of blocks are tiles.
    """
    names = [f"f{j}" for j in range(NEAR_WORDS)]
    near = saved(components(links(one, NEAR_RADIUS, NEAR_WORDS, least, tile)).join(one, "node"), "near-candidates")
    size = near.groupBy("component").agg(F.greatest(F.ceil(F.sum("n_shingles") / held), F.ceil(F.count(F.lit(1)) / tile)).cast("int").alias("blocks"))
    # each candidate's text, from one document that has its set
    have = small(near.select("node", F.col("_k").alias("_rk"), F.col("_th").alias("_rth")))
    texts = docs.select(F.col(key).alias("_dk"), F.col(text).alias("text"), F.xxhash64(text).alias("_dth")).join(have, F.col("_dk").eqNullSafe(F.col("_rk")) & (F.col("_dth") == F.col("_rth")))
    texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    at = near.join(size, "component").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    at = at.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("mine"))))
    rows = at.join(texts, "node").select("component", "block", F.when(F.col("block") == F.col("mine"), 0).otherwise(1).alias("side"), "node", *names, "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "component", "block").sortWithinPartitions("component", "block", "side").mapInArrow(_verify(least, shingle), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = 0.8, tile: int = TILE, held: int = HELD) -> DataFrame:
    """(_k, _th, component) for each row of docs: its key, its text's hash and its group of near duplicates.

    Rows are linked if the sets of their five-word shingles have a Jaccard similarity of ``least`` or more (texts of
    fewer words are one shingle; texts without words are alike), and a group is what links reach. A component is a
    long that names the group, nothing more. Null texts are empty ones; rows of one key are told apart by their texts.
    """
    sig = saved(_signatures(docs, text, key, shingle), "near-signatures")
    one = saved(sig.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n_shingles", *[f"f{j}" for j in range(NEAR_WORDS)], "_k", "_th")]), "near-one")
    linked = saved(components(_similar(docs, one, text, key, shingle, least, tile, held)), "near-linked")
    return sig.select("_k", "_th", "node").join(linked, "node", "left").select("_k", "_th", F.coalesce("component", "node").alias("component"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """One row of each near-duplicate group of docs; columns as in docs.

    The row of the smallest key stays (null last, then by text hash). Of rows that agree in key and text the one that is
    first as JSON stays. Only what goes meets the documents, by broadcast while it is few.
    """
    got = saved(near_duplicates(docs, text, key, **how), "near")
    rank = F.struct(F.col("_k").isNull().alias("no"), "_k", "_th")
    groups = got.groupBy("component").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = saved(got.join(groups, "component").select("_k", "_th", (rank == F.col("best")).alias("stays")).groupBy("_k", "_th", "stays").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    named = lambda x: x.select(F.col("_k").alias("_near_k"), F.col("_th").alias("_near_th"))
    whole, digest = as_rows(docs), F.xxhash64(field(text))
    same = field(key).eqNullSafe(F.col("_near_k")) & (digest == F.col("_near_th"))
    twice = named(rows.where("stays and n > 1"))
    n_twice = twice.count()
    out = whole.join(small(named(rows.where("not stays" if not n_twice else "not stays or n > 1"))), same, "left_anti")
    if not n_twice:
        return as_columns(out, docs)
    again = whole.join(small(twice, n_twice), same, "left_semi")
    again = again.withColumn("_near_n", F.row_number().over(W.partitionBy(field(key), digest).orderBy(F.to_json("_row"))))
    return as_columns(out.unionByName(again.where("_near_n = 1").select("_row")), docs)
