import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import neighbours


def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == len(rows[0][1])]
    out = {}
    for i, q in ok:
        if i % 50 == 0:
            s = {j: float((q * v).sum() / np.sqrt((q * q).sum()) / np.sqrt((v * v).sum())) for j, v in ok if j != i}
            out[i] = sorted(s.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def run(spark, rows):
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_tables_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(120)]
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [1.0, None] * 4), (1150, [float("nan")] + [1.0] * 7), (1200, [float("inf")] * 8), (1250, [1.0] * 7), (None, [1.0] * 8)]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        np.testing.assert_allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_few_and_no_candidates(spark):
    assert run(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]).keys() == {0}
    assert len(run(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])])[0]) == 1
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 100)
    monkeypatch.setattr(neighbours, "SLICE", 30)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(3000, 16)) + 2 * rng.normal(size=(10, 16))[rng.integers(10, size=3000)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_query_with_ties_repeated_rows_and_clashing_names(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(3)], i, 0.5) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0, 0.0) for i in range(8)] + [rows[50], rows[50], (None, rows[0][1], 1, 1.0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    got, want = {}, brute(stored)
    for r in neighbours.query(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert got == {q: {n + 1: i for n, (i, _) in enumerate(x)} for q, x in want.items()}
