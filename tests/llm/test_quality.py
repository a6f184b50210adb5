import math
import random
import zlib

import numpy as np

from ledgerlens.llm import quality


def sample(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts, grades = [], []
    for _ in range(n):
        t, g = [rng.choice(words) for _ in range(rng.choice([5, 60, 300]))], rng.choice([0, 1, 2, 2])
        if g == 0:
            t = [w + "###" for w in t]
        if g == 1:
            t[:: max(1, len(t) // 4)] = ["moron"] * len(t[:: max(1, len(t) // 4)])
        texts.append(" ".join(t).encode())
        grades.append(g)
    return texts, np.array(grades)


def test_held_out_grades_and_order():
    fitted, known = sample(1500, 1)
    model = quality.Ordinal.fit([quality.hashed(t) for t in fitted], known, 3)
    texts, grades = sample(200, 2)
    p = model.tail(np.array([model.score(t) for t in texts]))
    assert np.all(np.diff(model.thresholds) > 0) and np.all(p[:, 0] >= p[:, 1])
    assert ((p > 0.5).sum(axis=1) == grades).mean() > 0.9


def test_likelihood_gradient_reaches_the_base_rates():
    model = quality.Ordinal.fit([quality.hashed(b"")] * 100, np.array([0] * 20 + [1] * 30 + [2] * 50), 3)
    np.testing.assert_allclose(model.tail(np.array([model.score(b"")]))[0], [0.8, 0.5], atol=0.03)


def test_tables(spark):
    texts, grades = sample(300, 3)
    rows = [(i, t.decode(), "x", 1.0) for i, t in enumerate(texts)] + [(None, "w1 w2", None, None), (400, None, "x", 2.0), (401, "", "x", 2.0), (0, texts[0].decode(), "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, p_1 double")
    marks = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, g in enumerate(grades.tolist())] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.grades(marks))
    got = quality.judge(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.p_2 <= r.p_1 <= 1 and abs(r.expected_grade - r.p_1 - r.p_2) < 1e-12 for r in got)
    kept = quality.select(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.p_2 >= quality.KEEP for r in got)
    none = spark.createDataFrame([], docs.schema)
    empty = quality.fit(none, quality.grades(marks.limit(0)))
    assert quality.judge(none, empty).count() == 0 and quality.judge(docs, empty).count() == len(rows)


def test_query_equals_plain_sums(spark, tmp_path):
    """The registered query against the formulas, token by token, with the weights of its own fit."""
    texts, grades = sample(200, 6)
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(None, "w1"), (500, None), (501, ""), (502, "moron " * 30_000), (3, texts[3].decode()), (3, "other text")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(g > 0), int(g == 1)) for i, g in enumerate(grades.tolist())]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.query(spark, str(tmp_path)).collect()
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    m = quality.fit(docs, quality.grades(labels))

    def plain(text):
        known = [(quality.WORDS * (t[:1] == b"\x00") + zlib.crc32(t) % quality.WORDS, t[:1] != b"\x00") for t in quality.tokens(text)]
        root = math.sqrt(max(1, sum(w for _, w in known)))
        score = sum(m.weights[c] * (m.scale[c] / root if w else 1) for c, w in known)
        return [1 / (1 + math.exp(t - score)) for t in m.thresholds]

    assert len(got) == len(rows)
    want = sorted((k is None, k or 0, *(round(x, 9) for x in plain(None if t is None else t.encode()))) for k, t in rows)
    assert want == sorted((r.doc_id is None, r.doc_id or 0, round(r.p_1, 9), round(r.p_2, 9)) for r in got)
    assert all(abs(r.expected_grade - r.p_1 - r.p_2) < 1e-12 and r.keep == (r.p_2 >= quality.KEEP) for r in got)
    assert not next(r for r in got if r.doc_id == 502).keep


def test_gradient_steps_raise_the_likelihood_as_plain_differences_do():
    """No weight of the fitted model can be moved for a clearly larger likelihood."""
    texts, grades = sample(120, 9)
    cols = [quality.hashed(t) for t in texts]
    m = quality.Ordinal.fit(cols, grades, 3, steps=600, decay=0.0)

    def likelihood(weights, thresholds):
        total = 0.0
        for c, g in zip(cols, grades):
            z = float((weights[c] * quality.values(c, m.scale)).sum())
            p = [1.0, *(1 / (1 + math.exp(t - z)) for t in thresholds), 0.0]
            total += math.log(max(p[g] - p[g + 1], 1e-300))
        return total / len(cols)

    best = likelihood(m.weights, m.thresholds)
    assert best > -0.05
    for c in np.unique(np.concatenate(cols))[::9]:
        for step in (-0.05, 0.05):
            moved = m.weights.copy()
            moved[c] += step
            assert likelihood(moved, m.thresholds) < best + 1e-3
