"""Source registry: which sources, and so which chunks, may be used; and the passage made of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import displayable, grounded, search_form


def small(df: DataFrame, most: int = 100_000, most_bytes: int = 32 << 20) -> DataFrame:
    """A side for a broadcast, if it has at most `most` rows that take at most `most_bytes` as text; else as it is, for Spark to choose the join."""
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    rows, taken = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and taken <= most_bytes else df


def without_excluded(sources: DataFrame, excluded: DataFrame, title: str = "title") -> DataFrame:
    """Sources whose title neither contains nor is contained in an excluded one, in search form; empty titles stay."""
    ex = excluded.select(search_form(title).alias("_ex")).where("_ex <> ''").distinct()
    x = sources.withColumn("_t", search_form(title))
    hit = (F.col("_t") != "") & (F.contains("_t", "_ex") | F.contains("_ex", "_t"))
    return x.join(small(ex), hit, "left_anti").drop("_t")


def source_allowed(sources: DataFrame, excluded: DataFrame, title: str = "title") -> DataFrame:
    """The stricter one-way test of a given title: it contains no excluded one; of active sources."""
    ex = excluded.select(search_form(title).alias("_ex")).where("_ex <> ''").distinct()
    return sources.where("status = 'active'").withColumn("_t", search_form(title)).join(small(ex), F.contains("_t", "_ex"), "left_anti").drop("_t")


def retrievable(sources: DataFrame, excluded: DataFrame) -> DataFrame:
    return without_excluded(sources.where("status = 'active'"), excluded)


def library_visible(sources: DataFrame, excluded: DataFrame) -> DataFrame:
    """Retrievable and not hidden; an unset flag means visible."""
    return retrievable(sources, excluded).where(F.coalesce(F.col("showInLibrary"), F.lit(True)))


def approved(chunks: DataFrame, sources: DataFrame, excluded: DataFrame) -> DataFrame:
    """Chunks of retrievable sources."""
    return chunks.join(small(retrievable(sources, excluded).select(F.col("id").alias("sourceId")).distinct()), "sourceId", "left_semi")


def passage(score: Column | None = None) -> list[Column]:
    """Columns of a passage from a chunk c joined to its source s.

    A matn that still carries its commentary is hidden, and so is an excerpt that isn't grounded in a shown matn.
    """
    full = F.when(displayable("c.hadithFullText"), F.col("c.hadithFullText"))
    evidence = F.concat_ws("\n", full, F.nullif(F.col("c.text"), F.lit("")))
    excerpt = F.when(full.isNotNull() & grounded("c.hadithText", evidence), F.col("c.hadithText"))
    same = ("text", "quranText", "quranReference", "explanationText", "explanationSourceUrl", "chapter", "page", "excerptType", "role", "keywords")
    source = F.struct(F.col("s.id").alias("sourceId"), *(F.col(f"s.{c}").alias(c) for c in ("slug", "title", "author", "publisher", "registryUrl")), F.coalesce("c.sourceUrl", "s.originalUrl").alias("originalUrl"), F.col("s.verificationUrl").alias("verificationUrl"), F.col("s.verificationLabel").alias("verificationLabel"))
    return [F.col("c.id").alias("chunkId"), *(F.col(f"c.{c}").alias(c) for c in same), excerpt.alias("hadithText"), full.alias("hadithFullText"), F.coalesce("c.citationStatus", F.lit("chapter-only")).alias("citationStatus"), (F.lit(0.0) if score is None else score).alias("score"), source.alias("source")]


def passages(chunks: DataFrame, sources: DataFrame, excluded: DataFrame) -> DataFrame:
    """Every resolvable chunk as a passage; the others drop out."""
    return chunks.alias("c").join(small(retrievable(sources, excluded)).alias("s"), F.col("c.sourceId") == F.col("s.id")).select("c.ord", *passage())


def coverage(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence and index chunks of each source; a null role is evidence, a source without chunks has zeros."""
    counts = chunks.groupBy(F.col("sourceId").alias("id")).agg(F.count_if(~F.col("role").eqNullSafe("index")).alias("evidence"), F.count_if(F.col("role").eqNullSafe("index")).alias("index"))
    return sources.select("id").join(counts, "id", "left").fillna(0, ["evidence", "index"])


def related(topics: DataFrame) -> DataFrame:
    """Edges (id, pos, related) of topics' related lists, unknown ids dropped."""
    edges = topics.select("id", F.posexplode("related").alias("pos", "related"))
    return edges.join(small(topics.select(F.col("id").alias("related"))), "related", "left_semi").select("id", "pos", "related")
