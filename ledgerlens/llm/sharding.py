"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of slots, bytes are added up per slot, and a
small versioned table says which shard a slot belongs to. Moving data means editing
that table: ``edited`` takes slots from shards above the mean and gives them to
shards below it, and leaves all others where they are. A record's slot never changes.

A slot that holds many more rows than others (records that are wholly equal) is cut into
parts of ``PARTS`` times the mean slot's rows, so that the map has at most
SLOTS * (1 + 1 / PARTS) keys (slot, part) however skewed the rows are; it goes to the
driver and into a broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import new_path, ranked, saved

SLOTS, SHARDS, PARTS = 8192, 40, 4
#: Bytes that a record costs besides its text.
OVERHEAD = 16
#: Exchanges between the fullest and the emptiest shard, at most.
EXCHANGES = 4_000


def slot_of(*columns: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, from its columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def edited(shard: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key after rebalancing, from the shard it has and its bytes.

    Shards above the mean release their largest keys that fit into the excess; released keys go, largest first, to the
    emptiest shard. Then the fullest and the emptiest shard swap two keys, or one gives the other a key, as long as
    that narrows the gap between them; a shard that nothing relieves is left and the next fullest one tried. Ties go by the key's number, so reruns agree. A shard number beyond those in
    use (a shard put in) is the emptiest one; keys of shards from ``shards`` on (a shard taken away) are all released.
    """
    shard, size = shard.copy(), size.astype(np.int64)
    order = np.argsort(-size, kind="stable")
    mean = size.sum() / shards
    load = np.bincount(shard, size, minlength=shards).astype(np.int64)
    pool = []
    for k in order.tolist():
        s = shard[k]
        if s >= shards or load[s] - size[k] >= mean:
            load[s] -= size[k]
            pool.append(k)
    load = load[:shards]
    for k in pool:
        shard[k] = np.argmin(load)
        load[shard[k]] += size[k]
    stuck = np.zeros(shards, bool)  # full by a key that fits nowhere else
    for _ in range(EXCHANGES):
        full, low = int(np.argmax(np.where(stuck, -1, load))), int(np.argmin(load))
        if stuck[full] or full == low:
            break
        gap = int(load[full] - load[low])
        mine, theirs = np.flatnonzero(shard == full), np.flatnonzero(shard == low)
        there = np.append(np.sort(size[theirs]), 0)  # a key against none is a move
        there.sort()
        want = size[mine] - gap // 2  # the partner that would halve the gap
        at = np.clip(np.searchsorted(there, want), 1, len(there) - 1) if len(there) > 1 else np.zeros(len(want), int)
        best = np.where(np.abs(there[at - 1] - want) <= np.abs(there[at] - want), at - 1, at) if len(there) > 1 else at
        moved = size[mine] - there[best]
        left = np.abs(gap - 2 * moved)
        i = int(np.argmin(left)) if len(mine) else -1
        if i < 0 or left[i] >= gap:
            stuck[full] = True
            continue
        partner = theirs[size[theirs] == there[best[i]]]
        if there[best[i]] and len(partner):
            shard[partner[0]] = full
        shard[mine[i]] = low
        load[full] -= moved[i]
        load[low] += moved[i]
    return shard


def slots_of(docs: DataFrame, record: list[Column], slots: int = SLOTS) -> DataFrame:
    """docs with _slot, _part and _place (within the part), and nothing else changed."""
    order = tuple(f"_o{i}" for i in range(len(record)))
    x = docs.withColumns({**dict(zip(order, record)), "_slot": slot_of(*record, slots=slots)})
    x = saved(x, "slots")
    most = max(1, -(-PARTS * x.count() // slots))
    x = ranked(x, "_slot", order, "_at", "_of")
    return x.select(*docs.columns, "_slot", F.floor(F.col("_at") / most).cast("int").alias("_part"), (F.col("_at") % most).alias("_place"))


def slot_map(placed: DataFrame, size: str, shards: int = SHARDS, path: str | None = None) -> str:
    """Writes the map of ``slots_of``'s table and returns its folder: rows (version, slot, part, shard, n, bytes).

    Version 0 deals slots out in turn; version 1 is that, edited by the bytes that the slots hold.
    """
    spark = placed.sparkSession
    keys = placed.groupBy("_slot", "_part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).orderBy("_slot", "_part").toPandas()
    first = ((keys["_slot"] + keys["_part"]) % shards).to_numpy(np.int64)
    path = path or new_path(spark, "slot-map")
    for version, shard in enumerate((first, edited(first, keys["bytes"].to_numpy(np.int64), shards))):
        store(spark, path, version, keys["_slot"].tolist(), keys["_part"].tolist(), shard.tolist(), keys["n"].tolist(), keys["bytes"].tolist())
    return path


def store(spark, path: str, version: int, slot: list, part: list, shard: list, n: list, size: list) -> None:
    rows = list(zip(slot, part, shard, n, size))
    spark.createDataFrame(rows, "slot int, part int, shard int, n long, bytes long").coalesce(1).write.parquet(f"{path}/version={version}")


def load(spark, path: str, version: int) -> DataFrame:
    return spark.read.schema("slot int, part int, shard int, n long, bytes long").parquet(f"{path}/version={version}")


def rebalanced(spark, path: str, version: int, shards: int) -> int:
    """Edits a version of the map for a number of shards, greater, smaller or the same, stores it and returns the new version's number."""
    m = load(spark, path, version).orderBy("slot", "part").toPandas()
    shard = edited(m["shard"].to_numpy(np.int64), m["bytes"].to_numpy(np.int64), shards)
    store(spark, path, version + 1, m["slot"].tolist(), m["part"].tolist(), shard.tolist(), m["n"].tolist(), m["bytes"].tolist())
    return version + 1


def assigned(placed: DataFrame, mapping: DataFrame) -> DataFrame:
    """``slots_of``'s table with shard and slot, the row's number in its shard: gapless from 0, in the order of virtual slots."""
    before = W.partitionBy("shard").orderBy("slot", "part").rowsBetween(W.unboundedPreceding, -1)  # a map's rows, a few thousand
    m = mapping.select(F.col("slot").alias("_s"), F.col("part").alias("_p"), "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    out = placed.join(F.broadcast(m), (F.col("_slot") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    kept = [c for c in placed.columns if c not in ("_slot", "_part", "_place")]
    return out.select(*kept, "shard", (F.col("_base") + F.col("_place")).cast("long").alias("slot"))


def sharded(docs: DataFrame, record: list[Column], size: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with shard (from 0) and slot: shards of nearly equal bytes, as near as the largest record lets them be.

    ``record`` are the columns that name a record and are hashed; ``size`` is a column of its bytes. Rows that agree in
    all of them are interchangeable, and however many they are they spread over shards. Null keys are hashed like any
    other; an empty table gives no rows. Columns pass through, unless they are called shard, slot or begin with an underscore.
    """
    placed = slots_of(docs, record, slots)
    return assigned(placed, load(docs.sparkSession, slot_map(placed, size, shards), 1))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, by the law of equal bytes. A null text has no bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(b""))
    slim = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    out = sharded(slim, [F.col("doc_id"), F.col("digest")], "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
