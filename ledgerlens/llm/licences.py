"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory. DataFrame operations only.

A line of a file that holds an anchor word begins candidate headers: the line alone, with
the one after it, with the three after it, and with the one before and two after it, so
that a grant which runs over several lines meets its template as a whole. A licence file (LICENSE, COPYING, NOTICE ...) is a
candidate as a whole too. Terms are weighted by frequency and by inverse frequency over
all candidates of the corpus and the templates, and a candidate's cosine to each
template is a sparse dot product by an equi-join on terms. A file that has no licence of
its own takes that of the licence file in the nearest directory above it, found by joins
on the directories of its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: (licence, template): public grants, notices and whole short licences (fixed texts).
GRANTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD} {_BSD_1} {_BSD_2}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD} {_BSD_1} {_BSD_2} {_BSD_3}"),
    ("GPL-2.0-only", "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential"),
)
#: Identifiers that a tag may name and the licence that is reported for each: itself, but for the later versions of three.
TAGS = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 ISC Unlicense Zlib 0BSD BSL-1.0".split()
_GENERAL = {f"{x}-{v}": x for x in ("GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for v in ("only", "or-later")}
TEMPLATES = (*GRANTS, *((_GENERAL.get(x, x), f"SPDX-License-Identifier: {x}") for x in TAGS))
#: A header begins with a line that holds one of these; every template does.
ANCHOR = r"(?i)licen[sc]|copyright|spdx|permission|redistribut|public domain|rights reserved|warrant"
#: What denies a licence: from the negation over what is denied, which may stand on the next line, to the licence's name or the sentence's end.
DENIED = (
    r"(?i)\b(?:not|never|no longer)\b[^.]{0,25}?\b(?:licen[sc]e\b[^.\n]*|(?:licen[sc]ed|licen[sc]ing|released|distributed|covered|available)\b"
    r"(?:[^.\n]*licen[sc]e\b[^.\n]*|[^.\n]*\n[^.\n]*|[^.\n]*))\.?"
)
#: Names of licence files: nothing or a text's ending, a licence's name or a number after them.
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([.-](txt|md|markdown|rst|html?|none|lesser|lib|mit|apache|bsd|a?l?gpl|mpl|isc|zlib|[0-9]+))*$"
#: A tag that names several licences.
EXPRESSION = r"(?i)SPDX-License-Identifier:\s*\(?([A-Za-z0-9.+-]+(?:\s+(?:OR|AND)\s+[A-Za-z0-9.+-]+)+)"
OPERATOR = r"(?i)\s+(?:OR|AND)\s+"
#: Lines of a header, from the line that begins it.
SPANS = (1, 2, 4, 8)
LEAST = 0.6
TERM = r"[a-z0-9]+"


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0))


def _weights(lines: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, term, tf) of each line."""
    return lines.select(*ids, F.explode(_terms(F.col("line"))).alias("term")).groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))


def templates(spark: SparkSession) -> DataFrame:
    rows = [f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES)]
    return spark.sql("select * from values " + ", ".join(rows) + " as t(tid, licence, line)")


def _begins(line: Column) -> Column:
    return line.rlike(ANCHOR)


def granted(text: Column) -> Column:
    """The text without what denies a licence."""
    return F.when(text.rlike(DENIED), F.regexp_replace(text, DENIED, " ")).otherwise(text)


def _headers(text: Column, path: Column) -> Column:
    """The different candidates of a text with an anchor: headers of ``SPANS`` lines from each that begins one, of 4 from the line before, and a licence file as a whole.

    Each line is put beside those after it first, so that the steps of a long text take one look at it.
    """
    lines = F.transform(F.split(granted(text), "\n"), lambda x: F.trim(x))
    n, names = F.size(lines), [f"l{i}" for i in range(SPANS[-1])]
    beside = F.arrays_zip(*[(F.slice(lines, F.lit(i + 1), n) if i else lines).alias(c) for i, c in enumerate(names)])
    here = F.filter(beside, lambda z: _begins(z["l0"]) | F.coalesce(_begins(z["l1"]), F.lit(False)))
    span = lambda z, k: F.concat_ws(" ", *[z[c] for c in names[:k]])
    spans = F.flatten(F.transform(here, lambda z: F.when(_begins(z["l0"]), F.array(*[span(z, k) for k in SPANS])).otherwise(F.array(span(z, 4)))))
    whole = F.when(path.rlike(LICENCE_FILE) & F.exists(lines, _begins), F.array(F.array_join(lines, " "))).otherwise(F.array())
    return F.array_distinct(F.concat(spans, whole))


def _named_by(line: Column, licence: Column) -> Column:
    """The tag's expression, if a line has one of known licences only; else the licence."""
    e = F.regexp_extract(line, EXPRESSION, 1)
    known = F.size(F.array_except(F.split(e, OPERATOR), F.array(*map(F.lit, TAGS)))) == 0
    return F.when((e != "") & known, F.regexp_replace(e, r"\s+", " ")).otherwise(licence)


#: A candidate goes by 128 bits of hash, so that its text isn't carried along with each of its terms.
ID = ("h1", "h2")


def _named(lines: DataFrame) -> DataFrame:
    return lines.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def candidates(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """(h1, h2, line, uses) of the different candidates of all files: repeated ones are weighed once and counted by files."""
    t = files.where(F.col(text).rlike(ANCHOR)).select(F.explode(_headers(F.col(text), F.col(path))).alias("line"))
    return _named(t).groupBy(*ID).agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("uses"))


def match(lines: DataFrame, least: float = LEAST) -> DataFrame:
    """(h1, h2, licence, score): the nearest template of each of ``candidates``, if it reaches ``least``; ties to the first template."""
    spark = lines.sparkSession
    t = templates(spark)
    lines = saved(lines, "licence-lines")
    own = _weights(lines, [*ID, "uses"])
    known = _weights(t, ["tid"])
    total = lines.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("n")).select((F.col("n") + len(TEMPLATES)).alias("n"))
    df = own.groupBy("term").agg(F.sum("uses").alias("d")).unionByName(known.groupBy("term").agg(F.count(F.lit(1)).alias("d"))).groupBy("term").agg(F.sum("d").alias("d"))
    idf = saved(df.join(F.broadcast(total), F.lit(True)).select("term", F.log((1.0 + F.col("n")) / F.col("d")).alias("idf")), "licence-idf")
    w = own.join(idf, "term").select(*ID, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(*ID).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    tw = known.join(idf, "term").select("tid", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    tnorm = tw.groupBy("tid").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    # a template has at most a few dozen terms, so this side has about a thousand rows
    dot = w.join(F.broadcast(tw), "term").groupBy(*ID, "tid").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cos = dot.join(norm, list(ID)).join(F.broadcast(tnorm), "tid").select(*ID, "tid", F.round(F.try_divide("dot", F.col("norm") * F.col("tnorm")), 6).alias("score"))
    best = cos.groupBy(*ID).agg(F.max(F.struct("score", (-F.col("tid")).alias("t"))).alias("b")).select(*ID, F.col("b.score").alias("score"), (-F.col("b.t")).alias("tid"))
    return best.where(F.col("score") >= least).join(F.broadcast(t.select("tid", "licence")), "tid").select(*ID, "licence", "score")


def scan(files: DataFrame, path: str = "path", text: str = "text", least: float = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, path, licence, score, line, from_path) of each row of files.

    ``line`` is the matched header of the file itself or of the licence file ``from_path``
    whose licence it inherits; all null if there is neither. A file's best header wins,
    then the licence's name, then the header. Null paths are scanned but inherit nothing;
    rows of one path and text share their answer; an empty table gives no rows.
    """
    f = files.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(path).alias("path"), F.col(text).alias("text"))
    good = saved(match(candidates(f), least), "licence-good")
    # the anchor is looked for in the whole text first, so most files are done with one pass
    mine = f.where(F.col("text").rlike(ANCHOR)).select("path", F.xxhash64("text").alias("th"), F.explode(_headers(F.col("text"), F.col("path"))).alias("line"))
    mine = _named(mine).join(good, list(ID))
    own = mine.groupBy("path", "th").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence", "line")).alias("b"))
    own = saved(own.select("path", "th", F.struct(_named_by(F.col("b.line"), F.col("b.licence")).alias("licence"), (-F.col("b.s")).alias("score"), F.col("b.line").alias("line")).alias("own")), "licence-own")
    # licence files by their directory: the best of each, with its path
    dirs = own.where(F.col("path").rlike(LICENCE_FILE)).select(_parent(F.col("path")).alias("dir"), F.struct((-F.col("own.score")).alias("s"), "own.licence", "path", "own.line").alias("c")).groupBy("dir").agg(F.min("c").alias("c"))
    # the directories that files are in, once each, and their ancestors
    here = f.where("path is not null").select(_parent(F.col("path")).alias("home")).distinct()
    up = here.select("home", F.explode(_ancestors(F.col("home"))).alias("dir"))
    near = up.join(dirs, "dir").groupBy("home").agg(F.max(F.struct(F.length("dir").alias("depth"), "c")).alias("n")).select("home", "n.c")
    out = f.select(*[f"_keep_{c}" for c in keep], "path", F.xxhash64("text").alias("th"), _parent(F.col("path")).alias("home"))
    out = out.join(own.select(F.col("path").alias("_p"), F.col("th").alias("_t"), "own"), F.col("path").eqNullSafe(F.col("_p")) & F.col("th").eqNullSafe(F.col("_t")), "left").join(near, "home", "left")
    has = F.col("own").isNotNull()
    pick = lambda a, b: F.when(has, F.col(a)).otherwise(b)
    return out.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], "path", pick("own.licence", F.col("c.licence")).alias("licence"), pick("own.score", -F.col("c.s")).alias("score"), pick("own.line", F.col("c.line")).alias("line"), F.when(~has, F.col("c.path")).alias("from_path"))


def _parent(path: Column) -> Column:
    """Directory of a path, without a slash at its end; empty at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def _ancestors(home: Column) -> Column:
    """The directory itself and all above it, the top as an empty one."""
    parts = F.split(home, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def corpus_files(documents: DataFrame) -> DataFrame:
    """documents as a source tree: a source is a repository, a language a directory, documents go to ten modules.

    Every 97th document is named as a licence file, of its repository, its language's directory or its module in turn.
    """
    k = F.coalesce("doc_id", F.lit(0))
    top, language, module = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.lit("m"), F.pmod(k, F.lit(10)).cast("string"))
    home = F.concat_ws("/", top, language, module)
    third = F.pmod(k, F.lit(3))
    held = F.when(third == 0, top).when(third == 1, F.concat_ws("/", top, language)).otherwise(home)
    path = F.when(F.pmod(k, F.lit(97)) == 0, F.concat(held, F.lit("/LICENSE."), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))).otherwise(F.concat(home, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select("doc_id", path.alias("path"), "text")


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, path, licence, score, line and from_path of every document, as a file of ``corpus_files``."""
    files = corpus_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scan(files, keep=("doc_id",))


SQL = r"""
with t as (select * from (values @TEMPLATES@) as t(tid, licence, line)),
f0 as (
  select doc_id, text, coalesce(doc_id, 0) as k, coalesce(source, 'none') as top, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none')) as dir from documents),
f1 as (select *, dir || '/m' || cast(((k % 10) + 10) % 10 as varchar) as home0, k % 97 = 0 as held, ((k % 3) + 3) % 3 as third from f0),
f2 as (select *, case when not held or third = 2 then home0 when third = 0 then top else dir end as home,
              case when held then 'LICENSE.' || coalesce(cast(doc_id as varchar), 'none') else cast(doc_id as varchar) || '.txt' end as name from f1),
f as (select row_number() over () as rid, doc_id, text, home, name, held, list_transform(string_split(regexp_replace(text, '@DENIED@', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')) as ls from f2),
a as (select *, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '@ANCHOR@')) as anchors from f where regexp_matches(text, '@ANCHOR@')),
l as (
  select rid, home, name, held, unnest(list_distinct(list_concat(
    flatten(list_transform(anchors, lambda i: [ls[i], array_to_string(ls[i:i + 1], ' '), array_to_string(ls[i:i + 3], ' '), array_to_string(ls[i:i + 7], ' '),
      case when i > 1 then array_to_string(ls[i - 1:i + 2], ' ') else ls[i] end])), case when held and len(anchors) > 0 then [array_to_string(ls, ' ')] else [] end))) as line from a),
c as (select line, count(*) as uses from l group by line),
own as (select line, uses, term, count(*) as tf from (select line, uses, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) as term from c) group by all),
known as (select tid, term, count(*) as tf from (select tid, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) as term from t) group by all),
n as (select coalesce((select sum(uses) from c), 0) + (select count(*) from t) as n),
idf as (
  select term, ln((1.0 + any_value(n)) / sum(d)) as idf
  from (select term, sum(uses) as d from own group by term union all select term, count(*) from known group by term), n group by term),
w as (select line, term, tf * idf as w from own join idf using (term)),
tw as (select tid, term, tf * idf as tw from known join idf using (term)),
nw as (select line, sqrt(sum(w * w)) as norm from w group by line),
nt as (select tid, sqrt(sum(tw * tw)) as tnorm from tw group by tid),
cs as (
  select line, tid, round(dot / nullif(norm * tnorm, 0), 6) as score
  from (select line, tid, sum(w * tw) as dot from w join tw using (term) group by all) join nw using (line) join nt using (tid)),
b as (select line, licence, score from (select *, row_number() over (partition by line order by score desc, tid) as r from cs) join (select tid, licence from t) using (tid) where r = 1 and score >= 0.6),
m as (select rid, home, name, held, score, line, case when regexp_extract(line, '@EXPRESSION@', 1) <> '' and len(list_filter(regexp_split_to_array(regexp_extract(line, '@EXPRESSION@', 1), '@OPERATOR@'), lambda x: not list_contains([@TAGS@], x))) = 0
    then regexp_replace(regexp_extract(line, '@EXPRESSION@', 1), '\s+', ' ', 'g') else licence end as licence from (select *, row_number() over (partition by rid order by score desc, licence, line) as r from l join b using (line)) where r = 1),
lf as (
  select * from (select *, row_number() over (partition by home order by score desc, licence, home || '/' || name, line) as r from m where held) where r = 1),
h as (select distinct home from f),
near as (
  select home, lf_home from (select h.home, lf.home as lf_home, row_number() over (partition by h.home order by length(lf.home) desc) as r
    from h join lf on starts_with(h.home || '/', lf.home || '/')) where r = 1)
select f.doc_id, f.home || '/' || f.name as path, coalesce(m.licence, lf.licence) as licence, coalesce(m.score, lf.score) as score,
       coalesce(m.line, lf.line) as line, case when m.rid is null then lf.home || '/' || lf.name end as from_path
from f left join m using (rid) left join near on near.home = f.home left join lf on lf.home = near.lf_home
""".replace("@TEMPLATES@", ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TEMPLATES))).replace("@ANCHOR@", ANCHOR).replace("@DENIED@", DENIED).replace("@EXPRESSION@", EXPRESSION).replace("@OPERATOR@", OPERATOR).replace("@TAGS@", ", ".join(f"'{t}'" for t in TAGS))
