import random

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash

SCHEMA = "doc_id long, text string, component long"


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps, radius):
    """Smallest id reachable over links of at most radius bits."""
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if bin(fps[i] ^ fps[j]).count("1") <= radius and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


def test_fingerprint_bits():
    for t in ["", " \t\n", "One", "a b c", "a b c d a b c", "Ärger ÜBER x Y z", "w " * 2000, None]:
        f, _ = simhash.fingerprint(None if t is None else t.encode(), 3)
        assert int(f[0]) == plain(t)


def test_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    s = "the quick brün fox"
    assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] % 2**64 == xxhash.xxh64_intdigest(s.encode(), 42)


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "  ", "x", "x y"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([40, 200, 900]))]
        for _ in range(6):
            t = list(base)
            t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
        texts.append(" ".join(base))
        texts.append(" ".join(base).upper())
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(0, None, 5), (None, "x", 6)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fps = simhash.saved(simhash.fingerprints(docs), "t")
    got = simhash.groups(fps, tile=8).collect()
    assert len(got) == len(rows)
    want = brute({i: plain(t) for i, t in enumerate(texts)}, 2)
    assert len(set(want.values())) < len({plain(t) for t in texts})
    for r in got:
        assert r.component == (want[r.doc_id] if r.doc_id is not None else want[3])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.groups(simhash.saved(simhash.fingerprints(docs), "t")).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_near_duplicates_at_080(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(20):
        base = [f"{rng.randrange(10**6)}" for _ in range(300)]
        near, far = list(base), list(base)
        for i in rng.sample(range(300), 4):
            near[i] = "n"
        for i in rng.sample(range(300), 90):
            far[i] = "f" + str(i)
        texts += [base, near, far]
    rows = [(i, " ".join(t), 0) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {i for i in range(60) if i % 3 != 1}


def test_longer_fingerprints_are_mixed():
    f = simhash._majority(simhash.shingle_set(b"a b c d e f g h", 3), 4)
    assert len(set(f.tolist())) == 4 and f.dtype == np.uint64


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def plain_groups(texts, least=0.8):
    """Sets of keys that links of a Jaccard similarity of ``least`` or more reach, all pairs tried."""
    sets, comp = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if comp[a] != comp[b] and (x == y or len(x & y) >= least * len(x | y) - 1e-9):
                old, new = comp[a], comp[b]
                comp = {k: new if c == old else c for k, c in comp.items()}
    out = {}
    for k, c in comp.items():
        out.setdefault(c, set()).add(k)
    return list(out.values())


@pytest.mark.parametrize("tile,held", [(simhash.TILE, simhash.HELD), (5, 600)])
def test_near_duplicates_are_those_of_exact_similarity(spark, tile, held):
    rng = random.Random(tile)
    texts = {}
    for n in (9, 30, 200, 400):  # a group of copies that drift, on both sides of the bound
        base = [f"w{rng.randrange(10**4)}" for _ in range(n)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(max(2, n // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**4)}"
            texts[len(texts)] = " ".join(words)
    texts |= {200: "", 201: None, 202: "one", 203: "ONE", 204: "one two", 205: " ".join(["again"] * 5000)}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], SCHEMA).repartition(3)
    got = {}
    for r in simhash.near_duplicates(docs, tile=tile, held=held).collect():
        got.setdefault(r.component, set()).add(r._k)
    want = plain_groups(texts)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and 10 < len(want) < len(texts) - 10
    pairs = sum(1 for g in want for a in g for b in g if a < b and len(shingles(texts[a]) & shingles(texts[b])) < 0.8 * len(shingles(texts[a]) | shingles(texts[b])))
    assert pairs  # some are linked through others only
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, tile=tile, held=held).collect()}
    assert kept == {min(g) for g in want}


def test_repeated_and_null_keys(spark):
    long, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, long, 0), (1, other, 0), (1, other, 0), (1, other, 7), (None, long, 0), (None, "alone", 0), (None, "alone", 1), (2, None, 0), (3, "", 0)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, long), (1, other), (None, "alone"), (2, None)], key=str)
