import random

import corpus_pipeline
import public_tokenizers
import pytest
from ledgerlens.llm import pieces, quality
from tests.llm.test_lines import brute as plain_lines
from tests.llm.test_mixing import brute as plain_mix
from tests.llm.test_simhash import plain_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good, junk and copied documents, with nulls, empty texts and repeated rows."""
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(120):
        t = "\n".join(line(rng.choice([8, 25, 60])) for _ in range(rng.choice([1, 3, 6])))
        if i % 6 == 5:
            t = " ".join(w + "###" for w in t.split(" "))
        rows.append((i, t, "en", f"s{i % 3}" if i % 11 else None))
    for i in range(120, 150):  # copies, near copies
        words = rows[i % 5][1].split(" ")
        if i % 2:
            words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), "en", "s1"))
    rows += [(200, None, "en", "s0"), (201, "", None, "s1"), (None, line(30), "de", "s2"), rows[0]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, a, s, len(t or "")) for k, t, a, s in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(i % 6 != 5 or i >= 120), 0) for i in range(0, 150)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], folder)
        out.write.parquet(f"{folder}/step{len(steps)}")
        steps.append(spark.read.parquet(f"{folder}/step{len(steps)}"))
    rows = [x.collect() for x in steps]
    for x in steps[1:-1]:
        assert x.columns == docs.columns
    # 1: the model's decision on each row
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{folder}/labels.parquet")))
    keep = lambda r: model.tail([model.score(None if r.text is None else r.text.encode())])[0, -1] >= quality.KEEP
    assert sorted(map(str, rows[1])) == sorted(str(r) for r in rows[0] if keep(r))
    assert not any(r.doc_id is not None and r.doc_id < 120 and r.doc_id % 6 == 5 for r in rows[1]) and len(rows[1]) > 90
    # 2: all lines against all lines
    want = plain_lines({(r.doc_id, r.text): None for r in rows[1]}, 1)
    assert len(rows[2]) == len(rows[1]) and {r.doc_id: r.text for r in rows[2]} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows[2])
    # 3: all sets of shingles against all
    groups = plain_groups({(r.doc_id is None, r.doc_id): r.text for r in rows[2]})
    kept = {(r.doc_id is None, r.doc_id) for r in rows[3]}
    assert len(rows[3]) == len(kept) and kept == {min(g, key=lambda k: (k[0], k[1] or 0)) for g in groups}
    # 4: the mix by plain loops
    _, _, copies = plain_mix([(r.doc_id, r.text, r.source) for r in rows[3]])
    got = {}
    for r in rows[4]:
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == copies
    # 5: each text's ids give it back
    coder = pieces.coder(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in rows[4]}
    assert len(rows[5]) == len(rows[4]) and all(r.decoded_ok for r in rows[5])
    for r in rows[5]:
        import numpy as np

        assert coder.decode(np.array(r.ids, "<u4").tobytes()) == texts[r.doc_id]


def test_run_gives_the_last_stages_rows(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids_crc32", "decoded_ok", "ids"] and got.count() == spark.read.parquet(f"{folder}/step5").count()
