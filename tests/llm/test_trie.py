"""The trie of rebuilt conversations against a plain one of Python dicts, and the level-order form by itself."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import trie

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Every node's values from (conv_id, turn, role, text), by the contract's words."""
    label = lambda r: hashlib.md5(f"{len(r[0].encode())}:{r[0]}{r[1]}".encode()).hexdigest()
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, label((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saving = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saving[p] = (len(members[p]) - 1) * words + sum(saving[k] for k in children[p])
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saving[p], digest))
    return sorted(out, key=repr)


def report(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted(map(tuple, trie.nodes_report(df, **how).select(FIELDS).collect()), key=repr)


def test_query_is_the_plain_trie(spark):
    got = trie.query(spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got.columns == FIELDS
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


@pytest.fixture(scope="module")
def odd():
    """Nulls, ties, repeated rows, one first turn for many, equal conversations, and conversations that end inside others."""
    rng = np.random.default_rng(5)
    rows = [(None, 0, "user", "nobody's"), (1, None, None, None), (1, None, "user", None), (1, 3, "user", "  "), (1, 3, "user", "  "), (40, 0, "user", "a b c")]
    for c in range(20, 140):
        n = int(rng.integers(1, 7))
        rows += [(c, t, "user" if t % 2 == 0 else "bot", "hello there" if t == 0 else f"w{rng.integers(2)} " * (t + 1)) for t in range(n)]
    rows += [(c, t, "user", "the same again") for c in range(1000, 1030) for t in range(4)]
    rows += [(-7, 0, "user", "negative"), (2005, 0, "user", "alone and borrowed from none")]
    return rows


@pytest.mark.parametrize("limit", [5, 2000])
def test_odd_rows_and_upper_levels(spark, odd, limit):
    assert report(spark, [r for r in odd if r[0] is None or r[0] >= 0], limit=limit) == plain([r for r in odd if r[0] is None or r[0] >= 0])


def test_long_conversations_go_on_in_further_bands(spark, monkeypatch):
    monkeypatch.setattr(trie, "BAND", 4)
    rows = [(c, t, "user", f"turn {t if t < 9 else (t, c)} of all") for c in (20, 21, 22, 40) for t in range(14)]
    assert report(spark, rows, limit=6) == plain(rows)


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "PACK", 8)
    rows = [(c, 0, "user", "same") for c in range(0, 100)]
    assert report(spark, rows) == plain(rows)


def test_empty_table_and_other_columns(spark):
    assert report(spark, []) == []
    df = spark.createDataFrame([(1, 0, "u", "x", 5, "y")], "conv_id long, turn long, role string, text string, place int, label string")
    assert trie.nodes_report(df).count() == 2 - (zlib.crc32(b"1") % 4 > 0)


def test_level_order_trie_finds_paths():
    rng = np.random.default_rng(1)
    seqs = {tuple(rng.integers(0, 3, rng.integers(1, 6)).tolist()) for _ in range(40)}
    nodes = sorted({s[:d] for s in seqs for d in range(1, len(s) + 1)})
    at = {p: i for i, p in enumerate(nodes)}
    up = np.array([at.get(p[:-1], -1) for p in nodes])
    t, order = trie.Louds.of(np.array([len(p) for p in nodes]), up, np.array([p[-1] for p in nodes]))
    place = {nodes[i]: k + 1 for k, i in enumerate(order.tolist())}
    assert len(t.bits) == 2 * len(nodes) + 1 and t.bits.sum() == len(nodes)
    assert t.parents().tolist() == [place.get(nodes[i][:-1], 0) for i in order.tolist()]
    for p in nodes:
        node = 0
        for label in p:
            node = t.child(node, label)
        assert node == place[p]
    assert t.child(0, 99) is None


def test_stored_tries_hold_every_node(spark):
    df = spark.createDataFrame([(c, t, "user", f"{c % 3 if t < 2 else c} {t}") for c in range(30) for t in range(4)], "conv_id long, turn long, role string, text string")
    rows = trie.tries(df, limit=10).collect()
    nodes = trie.nodes_report(df, limit=10).where("depth > 0").count()
    assert sum(r["n"] for r in rows) == nodes
    for r in rows:
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)[: 2 * r["n"] + 1]
        assert bits.sum() == r["n"] and len(r["labels"]) == 32 * r["n"]
