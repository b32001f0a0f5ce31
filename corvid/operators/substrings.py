"""Which texts hold which patterns: an index join on short character grams, then a look at the pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import small

#: Characters of a pattern's beginning that are looked up, and of a word that stands for its pattern.
GRAM, WORD = 6, 3


def _grams(text: Column, lengths: range) -> Column:
    """Distinct substrings of these lengths."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{g}}}))"), F.lit(1)) for g in lengths))))


def _inner_word(pattern: Column) -> Column:
    """The longest of a pattern's words between two blanks, which a text that holds the pattern has as a whole word; null if it is too short."""
    parts = F.split(pattern, " ")
    inner = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return F.when(longest["n"] >= WORD, longest["w"])


def containing(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, least: int = 1) -> DataFrame:
    """Each row of texts beside each row of patterns whose pattern, of least characters or more, is part of the text.

    A pattern with a word between two blanks is looked up by its longest one among the words of the texts; of others the first GRAM characters (all,
    if it has fewer) are joined to the grams of the texts. Pairs that meet are compared. So a pair costs nothing unless they share a word or
    gram, on whichever side the many rows are, and texts have no grams made if every pattern has such a word. Distinct patterns meet the texts,
    and the rows that repeat them come back afterwards. The names of the columns of the two sides must differ.

    Nulls and empty patterns are in nothing; a null text holds nothing. Repeated rows: each has its pairs. Empty tables: empty result.
    """
    if clash := {c.lower() for c in texts.columns} & {c.lower() for c in patterns.columns}:
        raise ValueError(f"both sides have a column {sorted(clash)[0]}")
    p = patterns.where(F.length(pattern) >= max(1, least))
    begins = p.select(F.col(pattern).alias("_pattern"), _inner_word(F.col(pattern)).alias("_word")).distinct()
    # outer: explode would have its input made a second time, to filter by; merge: beside many patterns the exploded texts aren't broadcast, each with all of
    # its text (few patterns are, as that hint comes first)
    x = texts
    worded = begins.where("_word is not null").select("_pattern", F.col("_word").alias("_key"))
    met = x.withColumn("_k", F.explode_outer(F.array_distinct(F.split(F.col(text), " ")))).hint("merge").join(small(worded), F.col("_k") == F.col("_key"))
    if not p.where(_inner_word(F.col(pattern)).isNull()).isEmpty():
        # the gram of an empty text is no pattern's
        rest = begins.where("_word is null").select("_pattern", F.left("_pattern", F.lit(GRAM)).alias("_key"))
        grams = x.withColumn("_k", F.explode_outer(_grams(F.col(text), range(min(max(1, least), GRAM), GRAM + 1))))
        met = met.unionByName(grams.hint("merge").join(small(rest), F.col("_k") == F.col("_key")))
    # coalesce: a plain condition says that the text isn't null, and a filter would make it a second time to see
    met = met.where(F.coalesce(F.contains(text, "_pattern"), F.lit(False)))
    return met.join(small(p), F.col("_pattern") == F.col(pattern)).drop("_k", "_key", "_pattern")
