"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise, text_or_empty

#: A line is boilerplate of a host if more than LINE_DOCS of its documents hold it, at every size of the host.
LINE_DOCS = 20
#: A document is depleted if fewer than LEFT_WORDS words, or less than LEFT_SHARE of them, are outside such lines.
LEFT_WORDS, LEFT_SHARE = 20, 0.3
MIN_WORDS, REPEAT_PERCENT = 50, 50


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _base(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The base figures, and lines: an array of (hash of the line's words in lower case, words, place from 1) of a document's lines with words."""
    text = text_or_empty(text_col)
    x = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("t")).withColumn("w", words(F.col("t")))
    x = x.withColumn("n_words", F.size("w").cast("long"))
    # hash of each 3-word window with its place; sorted, equal windows are neighbours
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))))
    x = x.withColumn("s", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h: bigint, i: int>>"))))
    same = lambda a, b: F.coalesce(F.get("s", a)["h"] == F.get("s", b)["h"], F.lit(False))
    twice = F.filter("s", lambda v, k: same(k, k + 1) | same(k, k - 1))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda v: F.array(v["i"], v["i"] + 1, v["i"] + 2))))
    placed = F.transform(F.split("t", "\n", -1), lambda v, i: F.struct(v.alias("v"), (i + 1).alias("at")))
    x = x.withColumn("l", F.filter(placed, lambda v: F.length(F.btrim(v["v"], F.lit(" \t\n\x0b\f\r"))) > 0))
    return x.select(
        "id", "host", "t", "n_words",
        F.aggregate("w", F.lit(0).cast("long"), lambda a, v: a + F.length(v)).alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct(F.transform("l", lambda v: v["v"])))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.transform("l", lambda v: F.struct(_line_hash(v["v"]).alias("h"), F.size(words(v["v"])).alias("n"), v["at"].alias("at"))).alias("lines"),
    )


#: Above-limit lines up to this many are broadcast; beyond it Spark chooses the join.
BROADCAST_LINES = 200_000


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("n"))


def _above(x: DataFrame) -> DataFrame:
    """Of rows with host and lines: the lines above the limit (host, h). Each row is a document and counts once a line."""
    each = x.select(_key().alias("host"), F.explode(F.array_distinct(F.transform("lines", lambda v: v["h"]))).alias("h"))
    return materialise(each.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > LINE_DOCS).select("host", "h"), "boilerplate-lines")


def _few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES


def _removed(x: DataFrame, above: DataFrame) -> DataFrame:
    """(row, boilerplate_words, places in order) of rows that hold lines above the limit: a join on (host, h)."""
    held = x.select("row", _key().alias("host"), F.explode("lines").alias("v")).select("row", "host", "v.*")
    met = held.join(F.broadcast(above) if _few(above) else above, ["host", "h"])
    return met.groupBy("row").agg(F.sum("n").alias("boilerplate_words"), F.sort_array(F.collect_list("at")).alias("places"))


def _verdict() -> tuple[Column, Column]:
    """base_failed and kept, of the figures and boilerplate_words."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("boilerplate_words")
    depleted = (F.col("boilerplate_words") > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))
    return failed.alias("base_failed"), (~failed & ~depleted).alias("kept")


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.array_join(words(line), " ")))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: id, n_words, base figures, base_failed, boilerplate_words, kept.

    Lines are compared by their words in lower case. The documents that hold a line are counted per host (here the source):
    rows, exact copies too. Counting is partial before the shuffle, the few lines above the limit are written, and only
    they are joined back.

    Nulls: a null text has no words and fails; null hosts are one host; a null id is kept. Empty table: empty result.
    Repeated rows and ids: each row is judged alone. Other columns aren't read.
    """
    x = materialise(_base(docs, id_col, text_col, host_col).drop("t").withColumn("row", F.monotonically_increasing_id()), "line-figures")
    above = _above(x)
    removed = _removed(x, above).drop("places")
    x = x.drop("lines", "host").join(removed, "row", "left").withColumn("boilerplate_words", F.coalesce("boilerplate_words", F.lit(0)))
    failed, kept = _verdict()
    return x.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed, "boilerplate_words", kept)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """quality(), and clean_text: the text without its lines above the limits; all other lines, blank ones too, stay in order.

    Figures and texts are written once. The places of lines above the limit are found by the join that quality() makes, and each text is put
    together from what stands between its own places. Few such rows are broadcast, so that texts stay where they are.
    A null text gives an empty one. Rows that aren't kept have their text too. Repeated rows, ids, nulls and empty tables are as for quality().
    """
    x = materialise(_base(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "lined-texts")
    removed = materialise(_removed(x, _above(x)), "removed-lines")
    x = x.drop("lines", "host").join(F.broadcast(removed) if _few(removed) else removed, "row", "left").withColumn("boilerplate_words", F.coalesce("boilerplate_words", F.lit(0)))
    lines, last = F.split("t", "\n", -1), F.size(F.split("t", "\n", -1)) + 1
    bounds = F.concat(F.array(F.lit(0)), "places", F.array(last))
    between = F.transform(F.sequence(F.lit(1), F.size("places") + 1), lambda k: F.slice("split", F.get("bounds", k - 1) + 1, F.get("bounds", k) - F.get("bounds", k - 1) - 1))
    held = F.col("places").isNotNull()
    x = x.withColumns({"split": F.when(held, lines), "bounds": F.when(held, bounds)})
    text = F.when(held, F.array_join(F.flatten(between), "\n")).otherwise(F.col("t"))
    failed, kept = _verdict()
    return x.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed, "boilerplate_words", kept, text.alias("clean_text"))


#: DuckDB: the rows of op5; lines are compared as they are.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('h' || source, 'n') AS host FROM documents),
w AS (SELECT r, doc_id, t, host, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
k AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM k),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY r),
l AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM w),
lw AS (SELECT *, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw WHERE n > 0 GROUP BY r),
f AS (SELECT host, h FROM lw WHERE n > 0 GROUP BY host, h HAVING count(DISTINCT r) > {LINE_DOCS}),
b AS (SELECT r, sum(n) AS n FROM lw JOIN f USING (host, h) WHERE n > 0 GROUP BY r),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(b.n, 0) AS BIGINT) AS boilerplate_words
  FROM w LEFT JOIN u USING (r) LEFT JOIN p USING (r) LEFT JOIN b USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, boilerplate_words,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
  AND NOT (boilerplate_words > 0 AND (n_words - boilerplate_words < {LEFT_WORDS} OR n_words - boilerplate_words < {LEFT_SHARE}::DOUBLE * n_words)) AS kept FROM a
"""

#: DuckDB: the rows of op5_line_removal, the same with the digest of the text that is left.
CLEAN_ORACLE = ORACLE.replace("a AS (SELECT doc_id,", """e AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS pos, host FROM d),
o AS (SELECT r, pos, line, host, lower(array_to_string(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), ' ')) AS h FROM e),
c AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.h IS NULL), '') AS clean FROM o LEFT JOIN f ON o.host = f.host AND o.h = f.h GROUP BY r),
a AS (SELECT r, doc_id,""").replace("AS kept FROM a", "AS kept, sha256(clean) AS clean_sha256 FROM a JOIN c USING (r)")
