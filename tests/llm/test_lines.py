import random

import pytest

from ledgerlens.llm import lines

SCHEMA = "doc_id long, text string, norm string, first long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute(rows, threshold, min_chars=20):
    """Texts after dedup, by comparing all lines with all."""
    rows = list(rows)
    spots = sorted(((k is not None, k or 0, n), line.strip(" \t\r\x0b\x0c")) for k, t in rows if t is not None for n, line in enumerate(t.split("\n")))
    spots = [(at, x) for at, x in spots if len(x) >= min_chars]
    comp = list(range(len(spots)))
    for i in range(len(spots)):
        for j in range(i):
            a, b = spots[i][1], spots[j][1]
            if comp[i] != comp[j] and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    gone = {spots[i][0] for i in range(len(spots)) if comp[i] != i}
    return {k: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k is not None, k or 0, n) not in gone) for k, t in rows}


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([21, 30, 45, 80]))).strip() + "x" for _ in range(12)]
    base += [f"Item number {i:03d} of the list" for i in range(0, 60, 3)] + ["short", "", "}"]
    rows = []
    for i in range(40):
        out = []
        for _ in range(rng.randrange(1, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                if x:
                    p = rng.randrange(len(x))
                    x[p : p + rng.choice([0, 1])] = rng.choice(["", "z", "ü"])
            out.append("".join(x))
        rows.append((i, "\n".join(out)))
    return [*rows, (100, None), (101, ""), (None, base[0] + "\n" + base[1]), (102, " " + base[2] + "\t")]


@pytest.mark.parametrize("threshold,hot,chars", [(1, 40, 600), (1, 2, 600), (1, 2, 25), (2, 40, 600)])
def test_equals_brute_force(spark, monkeypatch, threshold, hot, chars):
    monkeypatch.setattr(lines, "HOT", hot)
    monkeypatch.setattr(lines, "HOT_CHARS", chars)
    rows = corpus(threshold + hot)
    docs = spark.createDataFrame([(k, t, "n", 1) for k, t in rows], SCHEMA).repartition(3)
    got = lines.dedup(docs, threshold=threshold).collect()
    want = brute(rows, threshold)
    assert len(got) == len(rows)
    assert {r.doc_id: r.text for r in got} == want
    assert sum(len(t or "") for t in want.values()) < sum(len(t or "") for _, t in rows)


def test_empty_table_and_repeated_rows(spark):
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(1, "one line that is long enough\nanother one that is long enough", "", 0)] * 3
    assert [r.text for r in lines.dedup(spark.createDataFrame(same, SCHEMA)).collect()] == [same[0][1]] * 3


def one_word(a, b):
    """Whether two lines' words differ in one place at most, by a word of a tenth of the others' characters or less."""
    x, y = a.split(), b.split()
    if x == y:
        return True
    cuts = lambda w: [(i, w[:i] + w[i + 1 :], w[i]) for i in range(len(w))]
    fits = lambda word, rest: 10 * len(word) <= sum(map(len, rest))
    if len(x) == len(y):
        return any(i == j and r == s and fits(v, r) and fits(w, s) for i, r, v in cuts(x) for j, s, w in cuts(y))
    return any(r == y and fits(v, r) for _, r, v in cuts(x)) or any(r == x and fits(v, r) for _, r, v in cuts(y))


@pytest.mark.parametrize("hot", [2, 40])
def test_a_word_replaced_put_in_or_left_out(spark, monkeypatch, hot):
    rng = random.Random(hot)
    monkeypatch.setattr(lines, "HOT", hot)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 5, 9]))) for _ in range(rng.choice([5, 12, 13, 30]))) for _ in range(8)]
    base += [" ".join(["again", "and"] * 9), "a-single-word-of-many-characters", "another-single-word-of-many-ones"]
    rows = []
    for i in range(60):
        out = []
        for _ in range(2):
            w = rng.choice(base).split(" ")
            p = rng.randrange(len(w))
            w[p : p + rng.choice([0, 1])] = rng.choice([[], ["replaced"], ["xy"], [""]])
            out.append(" ".join(w))
        rows.append((i, "\n".join(out)))
    want = brute_words(rows)
    got = lines.dedup(spark.createDataFrame([(k, t, "n", 1) for k, t in rows], SCHEMA).repartition(3), words=True).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert sum(map(len, want.values())) < sum(len(t) for t in brute(rows, 1).values())


def brute_words(rows):
    """brute for one edit of a character or one word."""
    spots = [((k, n), x.strip()) for k, t in rows for n, x in enumerate(t.split("\n")) if len(x.strip()) >= 20]
    comp = list(range(len(spots)))
    for i in range(len(spots)):
        for j in range(i):
            a, b = spots[i][1], spots[j][1]
            if comp[i] != comp[j] and (one_word(a, b) or abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    gone = {spots[i][0] for i in range(len(spots)) if comp[i] != i}
    return {k: "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone) for k, t in rows}


def test_short_lines_go_only_if_equal(spark):
    rows = [(1, "Les.\nLes!\n\n}"), (2, " Les.\n\nLes\nkept"), (3, "}\n\na line of twenty characters or more\nLes."), (4, "a line of twenty characters or mores")]
    docs = spark.createDataFrame([(k, t, "n", 1) for k, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in lines.dedup(docs, short=True).collect()}
    assert got == {1: "Les.\nLes!\n\n}", 2: "\nLes\nkept", 3: "\na line of twenty characters or more", 4: ""}


def test_hot_lines_on_both_sides_of_the_bound(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 2)
    monkeypatch.setattr(lines, "HOT_CHARS", 40)
    template = "".join(chr(ord("A") + i) for i in range(41))
    rows = [(0, template)] + [(i + 1, template[:i] + template[i + 1 :]) for i in range(41)]
    got = lines.dedup(spark.createDataFrame([(k, t, "n", 1) for k, t in rows], SCHEMA)).collect()
    assert {r.doc_id: r.text for r in got} == {k: template if k == 0 else "" for k, _ in rows} == brute(rows, 1)


def test_long_template_lines_make_no_pairs(spark, monkeypatch):
    """Thousands of long lines of one template with a running number: links in proportion to the lines, and one of them stays."""
    seen, write = [], lines.saved

    def counting(df, name):
        out = write(df, name)
        if name == "line-pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(lines, "saved", counting)
    n = 2000
    head, tail = "the head of a template that is long enough to be cut into parts " * 6, " and its tail after the running number, which is long as well" * 6
    docs = spark.createDataFrame([(i, f"{head}{i:05d}{tail}") for i in range(n)], "doc_id long, text string")
    assert len(head) + len(tail) > lines.HOT_CHARS
    kept = [r.doc_id for r in lines.dedup(docs).collect() if r.text]
    assert kept == [0] and sum(seen) <= 20 * n


def test_texts_are_split_once(spark, tmp_path):
    """Lines are taken from one split of their text, not from one for each line, and line counts need none."""
    many = "\n".join(f"line {i:06d} of a text" + "x" * (i % 50) for i in range(3000))
    rows = [(1, "line of many copies\n\n" + many), (2, many), (3, None), (4, ""), (5, "\n"), (6, "\t a line of twenty characters \x0b\x0c\r"), (7, "a line of twenty characters\nkept")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = lines.query(spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = {r.doc_id: (r.n_lines, r.n_kept, r.chars) for r in out.collect()}
    want = {k: 0 if t is None else len(t.split("\n")) for k, t in rows}
    assert {k: v[0] for k, v in got.items()} == want and {k: v[2] for k, v in got.items()} == {k: len(t or "") for k, t in rows}
    assert [got[k][1] for k in (2, 3, 4, 5, 6, 7)] == [0, 0, 0, 2, 1, 1]


def test_trimmed_lines(spark):
    from pyspark.sql import functions as F

    some = ["", " ", " \t\r", "a", " a", "a\x0b", "\x0ca b\r \t", "\xa0a\xa0", "é ", "\u3000x", "\x1fa", None]
    df = spark.createDataFrame([(x,) for x in some], "line string")
    assert [r[0] for r in df.select(lines._trimmed(F.col("line"))).collect()] == [x and x.strip(lines.BLANKS) for x in some]
