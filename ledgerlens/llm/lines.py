"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines within ``threshold`` edits of one another form classes; of each class the
earliest line in the corpus stays. A line is cut into threshold + 1 segments: of two
lines within the threshold, one has a segment that the other contains unchanged,
near the same place. Segments are indexed with their number and the line's length;
the probes are, for each length that can match, the substrings at the few places
where that segment can have moved to. What shares a key is verified by Spark's
``levenshtein`` with a threshold, which fills a band of that width.

Equal lines are one row before the join. A key that many different lines share
(templates, copies with edits) is not joined all against all: with a threshold of
1, lines differing in one character share the rest of the line around it, so
grouping by that rest gives the links without pairs. Lines too long for that are cut into
``PARTS`` parts; those that agree in all but one part are grouped so within that part.
Links are held to the lines' texts, however they were found.

With ``words``, lines whose words differ in one place are linked too, however many
characters that is: one word replaced, put in or left out, of at most a ``WORD_SHARE``-th
of the characters of the others. Half of the words bring candidates, and grouping by
all words but one gives the links, for hot keys as for others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import as_columns, as_rows, components, field, saved, small

#: Shorter lines are not compared by edits, as one edit is much of them; with ``short`` their exact repeats go.
MIN_CHARS = 20
#: Different lines on a key beyond which it is hot; characters up to which a hot line is taken character by character.
HOT, HOT_CHARS, PARTS = 40, 600, 16
#: A word that differs may have this part of the other words' characters; words stand between runs of these.
WORD_SHARE, SPACES = 10, r"[ \t\r\x0b\x0c]+"
#: What is taken off a line's ends.
BLANKS = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    """The line without blanks at its ends; looked for there first, as Spark's trim goes through every character."""
    blank = F.lit(False)
    for x in BLANKS:
        blank |= line.startswith(x) | line.endswith(x)
    return F.when(blank, F.trim(line, F.lit(BLANKS))).otherwise(line)


def n_lines(text: Column) -> Column:
    """The number of lines, counted by their ends; null for a null text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(_k, _th, n, norm, h1, h2) of each line of min_chars characters or more; 128 bits of hash stand for a line."""
    each = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_th"), F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    each = each.where(F.length("line") >= min_chars).select("_k", "_th", "n", _trimmed(F.col("line")).alias("norm"))
    return each.where(F.length("norm") >= min_chars).select("*", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"))


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of ``parts``; the last ones are longer by one."""
    base, rest = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    return base * i + F.greatest(F.lit(0), F.lit(i) - (parts - rest)), base + F.when(F.lit(i) >= parts - rest, 1).otherwise(0)


def _probes(threshold: int) -> list[tuple[int, int, int]]:
    """(d, segment, move) of each key of a line; an index key has neither d nor move."""
    out = []
    for d in range(threshold + 1):
        for i in range(threshold + 1):
            out += [(d, i, move) for move in range(max(-i, d - (threshold - i)), min(i, d + threshold - i) + 1)]
    return out


def _keys(norm: Column, threshold: int) -> Column:
    """Index keys and probes of a line as longs, in the order of ``_probes``; a probe at the segment's own place is the index key itself."""
    length, out = F.length(norm), []
    for d, i, move in _probes(threshold):
        start, size = _segment(length - d, i, threshold + 1)
        out.append(F.xxhash64(F.lit(i), length - d, norm.substr(start + move + 1, size)))
    return F.array(*out)


def _rows(lines: DataFrame, keys: str, index: list[int]) -> DataFrame:
    """(id, key, side) of each key of a line: side 0 for those at the places ``index``, else 1."""
    return lines.select("id", F.posexplode(keys).alias("at", "key")).select("id", "key", F.when(F.col("at").isin(*index), 0).otherwise(1).alias("side"))


def _without_one(line: Column, p: Column) -> Column:
    return F.concat(line.substr(F.lit(1), p - 1), line.substr(p + 1, F.length(line)))


def _centred(cut: DataFrame, *by: str) -> DataFrame:
    """Links (a, b) of rows (id, by, p, h, whole) to the centre of their group: a line without the character at p, or (p = 0) the whole line that others have one more than."""
    group = W.partitionBy(*by, "p", "h")
    centre = F.when(F.col("p") > 0, F.min("id").over(group)).otherwise(F.max(F.when(F.col("whole"), F.col("id"))).over(group))
    return cut.select("id", centre.alias("c")).where("c is not null and c <> id").select(F.col("id").alias("a"), F.col("c").alias("b"))


def _hot_links(hot: DataFrame) -> DataFrame:
    """Links of lines (id, norm) at distance 1: lines that agree but for the character at one place, or for one more."""
    p, norm = F.col("p"), F.col("norm")
    rest = F.xxhash64(norm.substr(F.lit(1), p - 1), norm.substr(p + 1, F.length("norm")))
    cut = hot.select("id", "norm", F.explode(F.sequence(F.lit(1), F.length("norm"))).alias("p")).select("id", "p", rest.alias("r"), F.xxhash64(_without_one(norm, p)).alias("x"))
    cut = cut.select("id", F.explode(F.array(F.struct(F.col("p").alias("p"), F.col("r").alias("h")), F.struct(F.lit(0).alias("p"), F.col("x").alias("h")))).alias("c")).select("id", "c.*", F.lit(False).alias("whole"))
    # a place and the rest of the line leave one character open, so these groups are small by construction
    return _centred(cut.unionByName(hot.select("id", F.lit(0).alias("p"), F.xxhash64("norm").alias("h"), F.lit(True).alias("whole"))).distinct())


def _long_links(hot: DataFrame) -> DataFrame:
    """The same for long lines, without pairs: lines that agree in all but one of ``PARTS`` parts are compared character by character in that part alone.

    A line stands under its own length (side 0) and, as the one with a character more in that part, under the length below
    (side 1). Only parts whose rest another line has are looked into.
    """
    length, out = F.length("norm"), []
    for d in (0, 1):
        for i in range(PARTS):
            start, size = _segment(length - d, i, PARTS)
            rest = F.xxhash64(F.lit(i), length - d, F.col("norm").substr(F.lit(1), start), F.col("norm").substr(start + size + d + 1, length))
            out.append(F.struct(rest.alias("key"), F.lit(d).alias("side"), F.col("norm").substr(start + 1, size + d).alias("part")))
    rows = saved(hot.select("id", F.explode(F.array(*out)).alias("x")).select("id", "x.*"), "line-parts")
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("side").alias("least")).where("low <> high and least = 0").select("key")
    rows = saved(rows.join(shared, "key"), "line-parts")
    p = F.col("p")
    place = rows.select("id", "key", "side", "part", F.explode(F.sequence(F.lit(1), F.greatest(F.length("part"), F.lit(1)))).alias("p"))
    h = F.xxhash64(_without_one(F.col("part"), p))
    cut = place.select("id", "key", F.when(F.col("side") == 0, p).otherwise(0).alias("p"), h.alias("h"), F.lit(False).alias("whole"))
    whole = rows.where("side = 0").select("id", "key", F.lit(0).alias("p"), F.xxhash64("part").alias("h"), F.lit(True).alias("whole"))
    return _centred(cut.unionByName(whole).distinct(), "key")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different lines on a key, one of them indexed."""
    a = rows.where("side = 0").select("key", F.col("id").alias("a"))
    p = a.join(rows.select("key", F.col("id").alias("b"), "side"), "key").where("a < b or (side = 1 and a <> b)")
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_keys(lines: DataFrame, threshold: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id, key, side, n) of keys that n different lines share, one of them indexed, and the pairs (a, b) to be verified.

    lines holds (id, keys), ``keys`` as from ``_keys``, one row for each different line. With a threshold of 1 a key of
    more than ``HOT`` lines gives no pairs.
    """
    rows = _rows(lines, "keys", [at for at, (d, _, move) in enumerate(_probes(threshold)) if d == move == 0])
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("side").alias("side"), F.count(F.lit(1)).alias("n"))
    shared = saved(shared.where("low <> high and side = 0").select("key", "n"), "line-keys")
    rows = saved(rows.join(shared, "key"), "line-rows")
    return rows, saved(_pairs(rows if threshold != 1 else rows.where(F.col("n") <= HOT)), "line-pairs")


def links(cold: DataFrame, hot: DataFrame, norm: DataFrame, threshold: int = 1, worded: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that reach every pair of lines within the threshold and, if ``worded`` are given, those of them whose words differ in one place.

    cold holds the pairs to be verified, hot the lines (id, norm) of hot keys, worded those of ``word_links``, norm
    (id, norm) of all lines of any. Texts meet all pairs at once, however they were found.
    """
    # lines of HOT_CHARS characters are in both, so that those of one more find them
    n_long, n_short = hot.agg(F.count_if(F.length("norm") >= HOT_CHARS), F.count_if(F.length("norm") <= HOT_CHARS)).first()
    pairs = cold
    if n_long:
        pairs = pairs.unionByName(_long_links(hot.where(F.length("norm") >= HOT_CHARS)))
    if n_short:
        pairs = pairs.unionByName(_hot_links(hot.where(F.length("norm") <= HOT_CHARS)))
    pairs = pairs.distinct().withColumn("by_words", F.lit(False))
    if worded is not None:
        pairs = pairs.unionByName(worded.withColumn("by_words", F.lit(True)))
    texts = saved(pairs, "line-pairs").join(norm.select(F.col("id").alias("a"), F.col("norm").alias("ta")), "a").join(norm.select(F.col("id").alias("b"), F.col("norm").alias("tb")), "b")
    # a link that rests on equal hashes is held to the lines
    near = F.levenshtein("ta", "tb", threshold).between(0, threshold)
    return texts.where(F.when(F.col("by_words"), _one_word_apart(F.split(_one_space(F.col("ta")), " "), F.split(_one_space(F.col("tb")), " "))).otherwise(near)).select("a", "b")


def _one_word_apart(a: Column, b: Column) -> Column:
    """Whether two arrays of words are equal but for one word, replaced or left out of one of them."""
    more = F.greatest(F.size(a), F.size(b))
    longer, other = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    p = F.array_position(F.zip_with(F.slice(longer, F.lit(1), F.size(other)), other, lambda x, y: x != y), True).cast("int")  # 0 if none differs
    tail = F.slice(longer, p + 1, more) == F.slice(other, F.when(F.size(a) == F.size(b), p + 1).otherwise(F.greatest(p, F.lit(1))), more)
    return (more - F.size(other) <= 1) & ((p == 0) | tail)


def _one_space(norm: Column) -> Column:
    """The line with one space between its words."""
    odd = F.lit(False)
    for x in ("  ", "\t", "\r", "\x0b", "\x0c"):  # looked for in the bytes, so that few lines meet the regular expression
        odd |= norm.contains(x)
    return F.when(odd, F.regexp_replace(norm, SPACES, " ")).otherwise(norm)


def _word_keys(spaced: Column) -> Column:
    """Keys of both halves of a line's words (at 0 and 1) and, as the one with a word more, of the halves of the others; spaced is from ``_one_space``."""
    words, out = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1, []
    for d in (0, 1):
        n = words - d
        half = F.floor(n / 2).cast("int")
        out += [F.xxhash64(F.lit(i), n, F.call_function("substring_index", spaced, F.lit(" "), part)) for i, part in enumerate((half, half - n))]
    return F.array(*out)


def shared_words(lines: DataFrame) -> DataFrame:
    """(id, halves) of lines that share half of their words with another; lines holds (id, word_keys).

    Bits of halves: 0 and 1 for the first and the second half shared with a line of as many words, 2 and 3 for those
    shared with a line of one word less, 4 for one shared with a line of one word more.
    """
    rows = lines.select("id", F.posexplode("word_keys").alias("at", "key"))
    own, longer = F.when(F.col("at") < 2, F.col("id")), F.when(F.col("at") >= 2, F.col("id"))
    shared = rows.groupBy("key").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.min(longer).alias("low_1"), F.max(longer).alias("high_1"))
    shared = shared.where("low is not null and least(low, low_1) <> greatest(high, high_1)")
    other = lambda low, high: F.coalesce((F.col(low) != F.col("id")) | (F.col(high) != F.col("id")), F.lit(False))
    bits = F.when(other("low", "high"), F.call_function("shiftleft", F.lit(1), F.col("at"))).otherwise(0)
    bits = bits.bitwiseOR(F.when((F.col("at") < 2) & other("low_1", "high_1"), 16).otherwise(0))
    return rows.join(shared, "key").groupBy("id").agg(F.bit_or(bits).alias("halves")).where("halves <> 0")


def word_links(norm: DataFrame) -> DataFrame:
    """Links (a, b), to be verified, that reach every pair of the lines (id, norm, halves) whose words differ in one place at most.

    The place lies outside a half that both have, so only the words there are left out in turn. A word and its place are
    one hash, the words of a line the exclusive or of theirs, so that a line without one word takes one step.
    """
    word = norm.select("id", "halves", F.posexplode(F.split(_one_space(F.col("norm")), " ")).alias("p", "w")).select("id", "halves", "p", F.length("w").alias("c"), F.xxhash64("p", "w").alias("h"), F.xxhash64(F.col("p") - 1, "w").alias("g"))
    line = W.partitionBy("id")
    upto = line.orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    word = word.select("id", "halves", "p", "c", "h", F.bit_xor("h").over(upto).alias("hs"), F.bit_xor("g").over(upto).alias("gs"), F.bit_xor("h").over(line).alias("h_all"), F.bit_xor("g").over(line).alias("g_all"), F.sum("c").over(line).alias("chars"), F.count("p").over(line).alias("n"))
    key = lambda p, h, whole: F.struct(p.cast("int").alias("p"), h.alias("h"), F.lit(whole).alias("whole"))
    bit = lambda i: F.col("halves").bitwiseAND(1 << i) != 0
    half, half_1 = F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2)
    small_word = F.col("c") * WORD_SHARE <= F.col("chars") - F.col("c")
    replaced = small_word & ((bit(0) & (F.col("p") >= half)) | (bit(1) & (F.col("p") < half)))
    left_out = small_word & ((bit(2) & (F.col("p") >= half_1)) | (bit(3) & (F.col("p") <= half_1)))
    # equal words between other spaces are a replacement at no place: all lines of a shared half have their whole
    whole = (F.col("p") == 0) & (F.col("halves") != 0)
    one = lambda when, k: F.when(when, F.array(k)).otherwise(F.array())
    cut = F.concat(
        one(replaced, key(F.col("p") + 1, F.col("h_all").bitwiseXOR(F.col("h")), False)),
        one(left_out, key(F.lit(0), F.col("hs").bitwiseXOR(F.col("h")).bitwiseXOR(F.col("g_all")).bitwiseXOR(F.col("gs")), False)),
        one(whole, key(F.lit(0), F.col("h_all"), True)),
    )
    cut = saved(word.select("id", F.explode(cut).alias("x")).select("id", "x.*"), "line-words")
    # many lines can agree but for one word: grouped minimums and a join, no window
    centre = cut.groupBy("p", "h").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.when(F.col("whole"), F.col("id"))).alias("whole_id")).where("low <> high")
    centre = centre.select("p", "h", F.when(F.col("p") > 0, F.col("low")).otherwise(F.col("whole_id")).alias("b")).where("b is not null")
    return cut.join(centre, ["p", "h"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def dropped(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = 1, min_chars: int = MIN_CHARS, words: bool = False, short: bool = False) -> DataFrame:
    """(_k, _th, drop): the line numbers, from 0, that go from each document that loses lines.

    Documents are told apart by key and text; rows equal in both are one document and
    get one answer. Earliest means smallest key (null first), then text hash, then line number.
    """
    occ = occurrences(docs, text, key, 1 if short else min_chars)
    keyed = occ.withColumn("keys", _keys(F.col("norm"), threshold))
    if words:
        keyed = keyed.withColumn("_spaced", _one_space(F.col("norm"))).withColumn("word_keys", _word_keys(F.col("_spaced")))
    names = ["keys", *["word_keys"] * words]
    at = F.struct("_k", "_th", "n", (F.length("norm") >= min_chars).alias("long"), *names)
    lines = keyed.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("copies"))
    lines = saved(lines.select("h1", "h2", F.struct("first._k", "first._th", "first.n").alias("first"), "first.long", *[f"first.{c}" for c in names], "copies"), "lines")
    compared = lines.where("long").select(F.col("h1").alias("id"), *names)

    rows, cold = shared_keys(compared, threshold)
    ids = cold.select(F.explode(F.array("a", "b")).alias("id")).select("id", F.lit(False).alias("hot"), F.lit(0).alias("halves"))
    if threshold == 1:
        ids = ids.unionByName(rows.where(F.col("n") > HOT).select("id", F.lit(True).alias("hot"), F.lit(0).alias("halves")))
    if words:
        ids = ids.unionByName(shared_words(compared).select("id", F.lit(False).alias("hot"), "halves"))
    ids = saved(ids.groupBy("id").agg(F.max("hot").alias("hot"), F.max("halves").alias("halves")), "line-ids")
    # the text of each line that is looked at, from one more pass over the documents
    norm = occ.select(F.col("h1").alias("id"), "h2", "norm").join(small(ids), "id").groupBy("id", "hot", "halves").agg(F.min(F.struct("h2", "norm")).alias("x"))
    norm = saved(norm.select("id", "hot", "halves", "x.*"), "line-texts")
    worded = word_links(norm.where("halves <> 0").select("id", "norm", "halves")) if words else None
    near = links(cold, norm.where("hot").select("id", "norm"), norm.select("id", "norm"), threshold, worded)
    # a line whose 64 bits another one has isn't in that one's class: the text that was compared has these 128
    classes = components(near).join(norm.select(F.col("id").alias("node"), "h2"), "node").select(F.col("node").alias("h1"), "h2", "component")
    member = lines.select("h1", "h2", "first").join(classes, ["h1", "h2"])
    keep = member.groupBy("component").agg(F.min("first").alias("keep"))
    near = saved(member.join(keep, "component").select("h1", "h2", "keep"), "line-classes")
    exact = lines.where("copies > 1").join(near, ["h1", "h2"], "left_anti").select("h1", "h2", F.col("first").alias("keep"))
    touched = saved(near.unionByName(exact), "line-touched")
    again = occ.select("h1", "h2", F.struct("_k", "_th", "n").alias("at"))
    gone = again.join(touched, ["h1", "h2"]).where(~F.col("at").eqNullSafe(F.col("keep")))
    return gone.groupBy("at._k", "at._th").agg(F.collect_set("at.n").alias("drop"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = 1, min_chars: int = MIN_CHARS, words: bool = False, short: bool = False) -> DataFrame:
    """The rows of docs with repeated lines taken out of ``text``; a null text stays null, other columns stay.

    A text that loses no line is not changed; one that loses all is empty. Lines of any length are compared whole, and an
    empty table gives no rows.
    """
    gone = saved(dropped(docs, text, key, threshold, min_chars, words, short), "line-drops")
    own = field(text)
    joined = as_rows(docs).join(gone.select("_k", "_th", F.col("drop").alias("_drop")).hint("merge"), field(key).eqNullSafe(F.col("_k")) & (F.xxhash64(own) == F.col("_th")), "left")
    # _parts is referred to twice, so that Spark keeps it as a column: within the lambda alone, texts were split for each line
    parts = F.col("_parts")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop")), lambda i: F.get(parts, i))
    out = joined.withColumn("_parts", F.when(F.col("_drop").isNotNull(), F.split(own, "\n"))).withColumn("_new", F.when(F.col("_drop").isNull(), own).otherwise(F.array_join(kept, "\n")))
    return as_columns(out, docs, **{text: F.col("_new")})


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, lines and characters before and after, and the digest of the deduplicated text, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    slim = dedup(docs.withColumn("n_lines", F.coalesce(n_lines(F.col("text")), F.lit(0))).withColumn("chars", F.coalesce(F.length("text"), F.lit(0))), words=True, short=True)
    return slim.select("doc_id", "n_lines", F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(n_lines(F.col("text"))).alias("n_kept"), "chars", F.coalesce(F.length("text"), F.lit(0)).alias("chars_kept"), F.md5("text").alias("text_md5"))
