"""The opN_ queries: thin selections over the operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, html_text, jaccard_join, language_id, line_quality, mixing, mtree, packing, periodic_runs, pii, token_counts, warc, whitening
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mtree.quantised(table(spark, sf_dir, "embeddings"))
    return mtree.top_k(x, x.where("vec_id % 100 = 0"), k=10)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), max_len=1024, end_id=2)
    return x.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return x.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(table(spark, sf_dir, "documents"))


def op5_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = line_quality.cleaned(table(spark, sf_dir, "documents"))
    return x.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def op6_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    aside = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs, ~aside)
    return language_id.identify(docs.select("doc_id", "text", aside.alias("held_out")), model).drop("text")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mixing.mix(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_dom_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_byte_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    x = byte_bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256)
    return x.select("doc_id", "n_tokens", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = periodic_runs.with_runs(periodic_runs.planted(table(spark, sf_dir, "documents")))
    # the greatest exact length / period, then the smallest start, then period: runs come in that order, so the first of the greatest stays
    larger = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda best, r: F.when(larger(best, r), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    x = x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return x.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mtree_topk, op2_token_counts, op3_pattern_packing, op4_boosted_pii, op5_line_frequency, op5_line_removal, op6_centroid_language, op7_jaccard_join, op8_systematic_mix, op9_dom_model_text, op10_warc_index_merge, op11_byte_bpe_transducer, op12_periodic_runs, op13_whitening)}

ORACLES: dict[str, str] = {"op1_mtree_topk": mtree.ORACLE, "op5_line_frequency": line_quality.ORACLE, "op5_line_removal": line_quality.CLEAN_ORACLE, "op7_jaccard_join": jaccard_join.ORACLE, "op8_systematic_mix": mixing.ORACLE.format(docs="documents"), "op10_warc_index_merge": warc.ORACLE}
