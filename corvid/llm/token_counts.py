"""Token counts through a digest cache: only distinct texts that the cache doesn't hold are encoded."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokenizing
from .common import discard, materialise, shared_root, text_or_empty

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"


#: Missing digests up to this many are sent to all tasks, so that no text is moved; beyond it Spark joins by shuffle.
BROADCAST_DIGESTS = 300_000


def cache_of(spark: SparkSession, model_path: str) -> str:
    """The cache of a tokenizer's version in the shared folder: every run there finds what earlier ones counted."""
    return f"{shared_root(spark)}/corvid/token-cache/{tokenizing.version_digest(model_path)}"


def token_counts(docs: DataFrame, model_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit), content_digest.

    The content is normalised only as far as counts can't change: a null text is an empty one. Its SHA-256 and the
    tokenizer file's are the cache's key. Distinct digests are joined to the cache at cache_path (a Parquet table; by default
    cache_of()), one text of each missing digest is encoded where it lies, and the counts are appended, so that a later call
    encodes only what is new, and moves no text if nothing is. Of several rows with a missing text, those of the smallest id
    are encoded. Two runs that append the same digest at once are harmless: the cache is read through a distinct.

    Nulls: a null text has 0 tokens; a null id is kept. Empty table: empty result. Repeated rows: each has its row.
    Ties: none. Other columns, whatever their names, aren't read. A text's length has no limit; one text is the
    largest unit that a worker holds beside its batch.
    """
    spark = docs.sparkSession
    version = tokenizing.version_digest(model_path)
    cache_path = cache_path or cache_of(spark, model_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def cache() -> DataFrame:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
        return known.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("content_digest"), text.alias("text"))
    keyed = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("content_digest"))
    missing = materialise(keyed.groupBy("content_digest").agg(F.min("id").alias("least"), F.count("*").alias("rows")).join(cache(), "content_digest", "left_anti"), "missing-digests")

    def encode(batches):
        count = tokenizing.piece_counts(model_path)
        for b in batches:
            digests, texts = b.column(0), b.column(1)
            for at in range(0, len(texts), 256):
                counts = count(texts.slice(at, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([digests.slice(at, 256), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    if new := missing.limit(BROADCAST_DIGESTS + 1).count():
        sought = missing if new > BROADCAST_DIGESTS else F.broadcast(missing)
        once = texts.join(sought.withColumnRenamed("content_digest", "digest"), (F.col("content_digest") == F.col("digest")) & F.col("id").eqNullSafe(F.col("least")))
        # of a text that several rows hold, the smallest id may stand on several of them: only these texts are dealt out by digest
        parts = [once.where("rows = 1")]
        if not missing.where("rows > 1").isEmpty():
            parts.append(once.where("rows > 1").dropDuplicates(["content_digest"]))
        for part in parts:
            part.select("content_digest", "text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    discard(missing)
    counted = keyed.join(cache(), "content_digest")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content_digest")
