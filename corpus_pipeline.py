"""From raw documents to packed training sequences, in five stages over the operators of corvid.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import jaccard_join, language_id, mixing, packing, pii
from corvid.llm.common import discard, materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a centroid of a language, learned from this stage's own labelled rows."""
    return language_id.keep_identified(docs, language_id.train(docs, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group that links of five-word shingles at a similarity of 0.8 connect."""
    return jaccard_join.drop_near_copies(docs, width=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # an executor still holds what the stages before it took: less room for units than packing alone has

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_len=1024, end_id=2, room=24 << 20)


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("personal data", redact_personal_data),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Regular expressions, boosted trees, centroids and tokenizers aren't SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        was, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}-{name.replace(' ', '-')}")
            if k:
                discard(was)
    return docs
