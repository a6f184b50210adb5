"""The manifest's roots, proofs and folded roots against plain Python trees."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from ledgerlens.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(hashes):
    """The last node, and each leaf's way to it as (sibling or None, whether the leaf's side is first)."""
    ways, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, k in enumerate(at):
            ways[i].append((hashes[k ^ 1] if k ^ 1 < len(hashes) else None, k % 2 == 0))
        hashes = [h(*hashes[k : k + 2]) for k in range(0, len(hashes), 2)]
        at = [k // 2 for k in at]
    return hashes[0], ways


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[2] is not None, (r[2] or "").encode())].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    tops, own = [], []
    for g in sorted(groups):
        groups[g].sort(key=lambda x: x[:3])
        top, ways = tree([x[2] for x in groups[g]])
        tops.append(top)
        own.append((groups[g], ways))
    out = []
    if tops:
        root, above = tree(tops)
    for top, way, (members, ways) in zip(tops, above if tops else [], own):
        for (_, _, mine, r), w in zip(members, ways):
            full = w + way
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            fold = leaf(*r[:3], r[3] + 1, r[4]) if hit else mine
            for s, first in full:
                fold = h(fold) if s is None else h(fold, s) if first else h(s, fold)
            out.append((r[0], mine, top, root, h(*(s for s, _ in full if s)), fold, fold == root))
    return sorted(out, key=repr)


def got(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "'x' as leaf", "1 as key", "2 as idx", "'g' as g")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.query(spark, f"file://{tmp_path}")
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=repr)


def test_trees_of_many_sizes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)  # several steps
    rows = [(100 * n + i, "s", f"l{n}", i, f"text {n} {i}") for n in (1, 2, 3, 4, 5, 7, 16, 17, 33) for i in range(n)]
    want = plain(rows)
    assert got(spark, rows, tmp_path) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "s", "é", 1, "x"), (7, "s", "", None, "null count"), (7, "s", "", 3, "same key"), (-3, "s", "z", 5, "a" * 300_000)]
    rows += [(11, "s", "en", 4, "the same row")] * 9 + [(i, None, "en", i, "") for i in range(20)]
    assert got(spark, rows, tmp_path) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 2, "alone")]])
def test_empty_table_and_one_row(spark, tmp_path, rows):
    assert got(spark, rows, tmp_path) == plain(rows)
