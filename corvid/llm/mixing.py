"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, text_or_empty

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"
#: Parts into which documents of one source and about one size are dealt, so that a hot source is ranked in many tasks.
SALTS = 128


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _size_class(size: Column) -> Column:
    """Sizes in ascending classes: the number of digits, then the two leading digits."""
    digits = size.cast("string")
    return (F.length(digits) * 100 + F.rpad(F.substring(digits, 1, 2), 2, "0").cast("int")).cast("int")


def _salt(id_column: Column) -> Column:
    """Ids of any pattern are dealt evenly: from four hexadecimal digits of the MD5 of the id as text; 0 for a null id."""
    return F.coalesce(F.conv(F.substring(F.md5(id_column.cast("string")), 1, 4), 16, 10).cast("int") % SALTS, F.lit(0))


def _targets(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size -> target: all sizes shared by weight, none above MOST_COPIES times its source's size.

    A source stays at its cap if, with those of smaller cap per weight taken off, its share of the rest would pass it.
    The window is over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    x = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * MOST_COPIES)
    x = x.withColumns({
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_need), F.lit(0)),
        "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_need), F.lit(0)),
    }).withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("left") * F.col("weight"))
    # the first source below its cap, in that order, has what the capped ones left
    rate = F.max(F.when(~F.col("capped"), F.col("left") / F.col("left_weight"))).over(whole)
    return x.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * rate).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document).

    Within a source each document is expected target / source_size times. Documents are laid out by source, size class,
    salt and doc_id; the prefix sum of the expected copies plus one random offset per source crosses an integer once per
    copy. Order by size keeps the words taken near the target. Only counts by (source, class, salt) and a row number
    within each are needed; a hot source is spread over classes and salts.

    Nulls: a null text has size 0; null sources are one source, the last; a null doc_id sorts first in its group. Empty
    table: empty result. Sources without words take nothing. Ties and repeated rows are numbered apart, and equal rows
    are interchangeable. Extra columns are kept, but for those named as the four that are added, which are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    return _laid_out(docs, weights, seed).select(*(c for c in docs.columns if c not in added), *(F.col(f"_mix_{c}").alias(c) for c in added))


def _laid_out(docs: DataFrame, weights: tuple[int, ...], seed: str) -> DataFrame:
    """docs with the columns of mix() under names that begin with _mix."""
    x = docs.withColumn("_mix_size", word_count(text_or_empty()))
    x = x.withColumns({"_mix_class": _size_class(F.col("_mix_size")), "_mix_salt": _salt(F.col("doc_id")), "_mix_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))})
    keys = ["_mix_source", "_mix_class", "_mix_salt"]
    groups = materialise(x.groupBy(*keys).agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("_mix_size").alias("words")), "mix-groups")
    sources = materialise(_targets(groups.groupBy("_mix_source").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")).select("source", "source_size"), weights), "mix-sources")
    before = Window.partitionBy("_mix_source").orderBy("_mix_class", "_mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    # the offset: 32 bits of a digest of seed and source
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_mix_source"))), 1, 8), 16, 10).cast("double") / 2.0**32
    laid = groups.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_before"))
    laid = laid.join(sources.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_mix_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target")), "_mix_source")
    rate = F.least(F.lit(float(MOST_COPIES)), F.col("_mix_target") / F.nullif(F.col("_mix_source_size"), F.lit(0)))
    laid = laid.withColumns({"_mix_offset": offset, "_mix_rate": F.when(F.col("_mix_source_size") > 0, rate).otherwise(0.0)})
    within = Window.partitionBy(*keys).orderBy("doc_id", "_mix_size")
    x = x.withColumn("_mix_row", F.row_number().over(within)).join(laid, keys)
    end = F.col("_mix_before") + F.col("_mix_row")
    copies = F.floor(F.col("_mix_offset") + end * F.col("_mix_rate")) - F.floor(F.col("_mix_offset") + (end - 1) * F.col("_mix_rate"))
    return x.withColumn("_mix_copies", copies.cast("long"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document's columns, whatever their names, once per copy."""
    return _laid_out(docs, weights, seed).withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies").cast("int")))).select(*docs.columns)


#: DuckDB: the rows of op8, over any relation put for {docs}; the same layout, offsets and boundaries.
ORACLE = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {{docs}}),
laid AS (SELECT *, length(CAST(size AS VARCHAR)) * 100 + CAST(rpad(substr(CAST(size AS VARCHAR), 1, 2), 2, '0') AS INT) AS cls,
  coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS INT) % {SALTS}, 0) AS salt, coalesce('s' || source, 'n') AS sk FROM sized),
src AS (SELECT sk, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM laid GROUP BY sk),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM src),
x AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS rest_weight
  FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * rest_weight <= rest * weight AS capped FROM x),
t AS (SELECT sk, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * (max(CASE WHEN NOT capped THEN CAST(rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) END) OVER ()) END AS target FROM c),
n AS (SELECT laid.*, t.source_size, t.target, row_number() OVER (PARTITION BY laid.sk ORDER BY cls, salt, doc_id NULLS FIRST, size) AS k,
  CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0.0::DOUBLE END AS rate,
  CAST(CAST('0x' || substr(md5('{SEED}:' || laid.sk), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM laid JOIN t USING (sk))
SELECT doc_id, size, source_size, target, CAST(floor(u + k * rate) - floor(u + (k - 1) * rate) AS BIGINT) * size AS taken FROM n
"""
