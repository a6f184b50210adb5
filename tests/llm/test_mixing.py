import hashlib
import random
import re

from ledgerlens.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string, _h string"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute(rows, weights=(3, 1, 2), passes=2):
    """Sizes, targets and copies by plain loops."""
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + words(t)
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, total, open_ = {}, 1.5 * sum(size.values()), set(names)
    while True:
        left = total - sum(goal.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] >= passes * size[s]}
        if not over:
            break
        goal |= {s: float(passes * size[s]) for s in over}
        open_ -= over
    goal |= {s: level * weight[s] for s in open_}
    queue = []
    for i, s in enumerate(names):
        cum = 0
        for k, t in sorted(((k, t) for k, t, x in rows if x == s), key=lambda r: (hashlib.md5(str(r[0] if r[0] is not None else "").encode()).hexdigest(), r[0] or 0, words(r[1]))):
            cum += words(t)
            for p in range(passes):
                if words(t) and goal[s]:
                    queue.append(((cum + p * size[s]) / goal[s], i, hashlib.md5(str(k if k is not None else "").encode()).hexdigest(), p, k, s, words(t)))
    copies, used = {}, 0
    for *_, k, s, n in sorted(queue, key=lambda q: q[:4]):
        used += n
        if used > total:
            break
        copies[k, s] = copies.get((k, s), 0) + 1
    return size, goal, copies


def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 3, 10, 40]))), rng.choice(["a", "b", "b", "b", "é", None])) for i in range(200)]
    return [*rows, (900, None, "a"), (901, "", None), (902, " \t", "void"), (903, "one huge " * 300, "tail")]


def test_equals_plain_loops(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, s, 7, "x", "y") for k, t, s in rows], SCHEMA).repartition(5)
    size, goal, copies = brute(rows)
    got = mixing.queue(docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("size"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-9
        assert r.copies == copies.get((r.doc_id, r.source), 0)
    for s in size:
        taken = sum(r.copies * r.size for r in got if r.source == s)
        assert abs(taken - goal[s]) <= max(words(t) for _, t, x in rows if x == s)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(copies.values())


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == 0
    same = spark.createDataFrame([(1, "a b c", "s", 0, "", "")] * 4 + [(2, "a", "t", 0, "", "")], SCHEMA)
    first, again = (sorted(map(tuple, mixing.mix(same).collect())) for _ in range(2))
    assert first == again and len(first) >= 4
    blank = spark.createDataFrame([(1, "", "s", 0, "", ""), (2, None, None, 0, "", "")], SCHEMA)
    assert [r.copies for r in mixing.queue(blank.select("doc_id", "source", mixing.n_words(blank["text"]).alias("size"))).collect()] == [0, 0]


def test_equal_rows_go_out_as_often_as_the_queue_takes_them(spark):
    same = [(1, "a b c d e f", "s", i, "", "") for i in range(50)] + [(2, "a b c", "t", 0, "", ""), (3, "a " * 40, "u", 0, "", "")]
    docs = spark.createDataFrame(same, SCHEMA)
    q = mixing.queue(docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("size"))).collect()
    out = [r.doc_id for r in mixing.mix(docs).collect()]
    assert len({r.copies for r in q if r.doc_id == 1}) == 2  # the cut lies among them
    assert {k: out.count(k) for k in (1, 2, 3)} == {k: sum(r.copies for r in q if r.doc_id == k) for k in (1, 2, 3)}


def test_the_cut_is_found_in_ever_shorter_stretches(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c"][i % 3]) for i in range(500)]
    docs = spark.createDataFrame([(k, t, s, 7, "x", "y") for k, t, s in rows], SCHEMA)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    monkeypatch.setattr(mixing, "TIME_STEPS", 4)
    got = mixing.queue(docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("size"))).collect()
    assert {(r.doc_id, r.source): r.copies for r in got if r.copies} == brute(rows)[2]


def test_query(spark, tmp_path):
    rows = corpus() + [(5, "x y", "a"), (5, "x y", "a"), (None, "z", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((k is None, k or 0, words(t)) for k, t, _ in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got) and got[0].__fields__[:5] == ["doc_id", "size", "source_size", "target", "taken"]
