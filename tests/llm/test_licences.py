import math
import re
from collections import Counter

from ledgerlens.llm import licences

FILES = [
    ("a/LICENSE", "Some title\nReleased under the MIT License.\n"), ("a/b/x.py", "# nothing here"), ("a/b/c/COPYING.txt", "  This work is licensed under the GNU General Public License, version 3.  "),
    ("a/b/c/d/e.py", ""), ("a/b/own.py", "Licensed under the Apache License, Version 2.0."), ("z/y.py", None), ("top.py", "all rights to reserve"), (None, "Licensed under CC BY-NC 4.0."),
    ("a/notice.md", "This licence is not known anywhere else at all"), ("a/b/x.py", "# nothing here"), ("a//q.py", "code"),
]


def brute(files):
    """(path, licence, from) by comparing every line with every template."""
    terms = lambda t: Counter(re.findall(r"[a-z0-9]+", t.lower()))
    def headers(p, t):
        ls = [x.strip(" ") for x in re.sub(licences.DENIED, " ", t).split("\n")] if t is not None else []
        at = [i for i, x in enumerate(ls) if re.search(licences.ANCHOR, x)]
        whole = [" ".join(ls)] if at and p and re.search(licences.LICENCE_FILE, p) else []
        before = [" ".join(ls[i - 1 : i + 3]) for i in at if i]
        return list(dict.fromkeys([" ".join(ls[i : i + n]) for i in at for n in (1, 2, 4, 8)] + before + whole))

    lines = [x for p, t in files for x in headers(p, t)]
    n = len(lines) + len(licences.TEMPLATES)
    df = Counter(w for x in [*lines, *[t for _, t in licences.TEMPLATES]] for w in terms(x))
    vec = lambda t: {w: c * math.log((1 + n) / df[w]) for w, c in terms(t).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def best(line):
        v, out = vec(line), (0.0, None)
        for name, t in licences.TEMPLATES:
            w = vec(t)
            s = round(sum(v[k] * w.get(k, 0) for k in v) / (size(v) * size(w)), 6) if size(v) * size(w) else 0
            if s > out[0]:
                out = (s, name)
        return out if out[0] >= licences.LEAST else None

    own = []
    for p, t in files:
        found = [(-b[0], b[1], x) for x in headers(p, t) if (b := best(x))]
        own.append(min(found) if found else None)
    top = {}
    for (p, _), o in zip(files, own):
        if p and o and re.search(licences.LICENCE_FILE, p):
            d = re.sub(r"/+$", "", re.sub(r"[^/]*$", "", p))
            top[d] = min(top.get(d, (1,)), (o[0], o[1], p))
    out = []
    for (p, _), o in zip(files, own):
        source = None
        if not o and p is not None:
            d = re.sub(r"/+$", "", re.sub(r"[^/]*$", "", p)).split("/")
            above = ["/".join(d[:i]) for i in range(len(d), -1, -1)]
            source = next((top[a] for a in above if a in top), None)
        out.append((p, o[1] if o else source and source[1], source and source[2]))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(p, t, "x", 1.0) for p, t in FILES], "path string, text string, licence string, score double").repartition(3)
    got = licences.scan(df).collect()
    assert sorted(((r.path, r.licence, r.from_path) for r in got), key=str) == brute(FILES)
    by = {r.path: r for r in got}
    assert by["a/b/x.py"].licence == "MIT" and by["a/b/c/d/e.py"].licence == "GPL-3.0" and by["a/b/own.py"].licence == "Apache-2.0" and by[None].licence == "CC-BY-NC-4.0"
    assert by["z/y.py"].licence is None and by["top.py"].licence is None


def test_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], "path string, text string")).count() == 0


HEADERS = {
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "GPL-3.0": "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "GPL-2.0-only": "# SPDX-License-Identifier: GPL-2.0-only",
    "BSD-2-Clause": "// SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause": "/* SPDX-License-Identifier: BSD-3-Clause */",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "AGPL-3.0": "it under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.',
}


def test_versions_and_denials(spark):
    rows = [(f"{i}/x.c", t) for i, t in enumerate(HEADERS.values())] + [("no/x.c", "This file is not released under the MIT License."), ("long/x.c", "word\n" * 50_000 + "Released under the MIT License.")]
    rows.append(("whole/LICENSE", licences.TEMPLATES[2][1].replace(", ", ",\n")))
    rows.append(("whole/src/deep/y.c", "int x;"))
    got = {r.path: r for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"{i}/x.c"].licence for i in range(len(HEADERS))] == list(HEADERS)
    assert got["no/x.c"].licence is None and got["long/x.c"].licence == "MIT"
    assert got["whole/LICENSE"].licence == "MIT" and got["whole/LICENSE"].score > 0.9 and got["whole/src/deep/y.c"].from_path == "whole/LICENSE"


def test_query_inherits_from_directories_above(spark, tmp_path):
    rows = [(0, "Released under the MIT License.", "en", "web"), (97, "Licensed under CC BY-SA 4.0", "en", "web"), (194, "Licensed under CC BY-NC 4.0", "en", "web"), (-96, "x", "en", "web"), (-97, None, "en", "web"), (5, "", "en", "web"), (17, "y", "en", "web"), (4, "z", "de", "web"), (4, "z", "de", "web"), (None, "q", None, None), (8, "Released under the MIT License.", "fr", "books")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = licences.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    by = {r.doc_id: (r.licence, r.from_path) for r in got}
    assert by[-97] == ("CC-BY-SA-4.0", "web/en/LICENSE.97") and by[4] == ("MIT", "web/LICENSE.0") and by[17] == ("CC-BY-SA-4.0", "web/en/LICENSE.97")
    assert by[-96] == ("CC-BY-NC-4.0", "web/en/m4/LICENSE.194") and by[None] == (None, None) and by[8] == ("MIT", None)


def test_denials_names_and_expressions(spark):
    """Denials over line ends, grants after them, file names that only begin like a licence's, and tags of several licences."""
    cases = {
        "a/x.c": ("This code is NOT\nreleased under the MIT License.", None),
        "b/x.c": ("no longer under\nthe Apache License. Licensed under the MIT License.", "MIT"),
        "c/x.c": ("# not released under the MIT License\n# Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        "d/x.c": ("You may not use this file except\nin compliance with the License.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
        "e/x.c": ("// SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
        "f/x.c": ("// SPDX-License-Identifier: (BSD-3-Clause AND MIT)", "BSD-3-Clause AND MIT"),
        "g/license_checker.py": ("Released under the MIT License.", "MIT"), "g/other.py": ("code", None),
        "h/notice_board.txt": ("Released under the MIT License.", "MIT"), "h/other.py": ("code", None),
        "i/LICENSE-MIT": ("Released under the MIT License.", "MIT"), "i/other.py": ("code", "MIT"),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _) in cases.items()], "path string, text string")
    got = {r.path: r.licence for r in licences.scan(df).collect()}
    assert got == {p: want for p, (_, want) in cases.items()}
