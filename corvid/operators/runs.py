"""Whole runs: from landed pages to a published or rejected corpus, and from evaluated cases to a report; each with a ledger of what happened.

Figures of a run are observed while its tables are written, so that no table is read again to count it.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corvid.functions import html as H
from corvid.functions import matn
from corvid.functions.text import grounded
from corvid.sources import Kept, Snapshots

from . import evaluation, ingest

#: Why a page is rejected, as counted by a run; reasons that name a page's id count together.
REASONS = ("empty-response", "block-page", "no-arabic-content", "site-error-page", "page-does-not-reference-itself", "no-matn-extracted", "matn-too-short", "matn-does-not-match-result-excerpt", "not-allowed-origin")
LEDGER = "run_id string, accepted boolean, reason string, version string, pages long, usable long, chunks long, duplicates long, full_texts long, explanations long, failures map<string, long>, topics map<string, long>, finished_at timestamp"


class Limits(NamedTuple):
    """What a run must reach to be published; fixed values of the usual manifest."""

    rows: int = 100
    topic: int = 3
    shrink_ok: bool = False


def verdicts(pages: DataFrame, origins: list[str], parameter: str = "mainId") -> DataFrame:
    """pages (ord, url, html, title, chapter, topics) with d, the struct of detail_page(); a page of another origin isn't read."""
    allowed = F.exists(F.array(*map(F.lit, origins)), lambda o: F.startswith(F.coalesce("url", F.lit("")), o))
    x = pages.withColumn("d", matn.detail_page(F.when(allowed, F.col("html")), "url", "title", parameter))
    reason = F.when(~allowed, "not-allowed-origin").otherwise(F.regexp_replace("d.reason", f"^page-does-not-reference-{parameter}-.*$", "page-does-not-reference-itself"))
    return x.withColumn("reason", reason)


def chunks_of(usable: DataFrame, source_id: str, prefix: str) -> DataFrame:
    """Corpus rows of usable verdicts: merged by matn, numbered, with a short excerpt only where the matn holds it, and where they come from."""
    x = usable.withColumns({"short": matn.snippet("title"), "matn": F.col("d.matn")})
    records = x.select("ord", F.col("short").alias("title"), F.coalesce(F.nullif("matn", F.lit("")), "short").alias("text"), F.col("matn").alias("hadithFullText"), F.col("d.explanation").alias("explanationText"), "topics")
    found = ingest.merge(records, prefix)
    rest = x.select("ord", "url", F.coalesce(F.nullif(H.clean(F.coalesce("chapter", F.lit(""))), F.lit("")), "short").alias("chapter"), "short")
    shown = F.when(grounded("short", "hadithFullText"), F.col("short"))
    out = found.join(rest, "ord").withColumns({"hadithText": shown, "sourceUrl": F.col("url"), "explanationSourceUrl": F.when(F.col("explanationText") != "", F.col("url"))})
    fixed = {"sourceId": source_id, "role": "evidence", "excerptType": "literal", "citationStatus": "verified-page"}
    out = out.withColumns({c: F.lit(v) for c, v in fixed.items()}).withColumn("htmlIngestion", F.struct(F.lit("official-html").alias("method"), F.col("url").alias("sourcePage")))
    return out.select("id", "ord", *fixed, "chapter", "sourceUrl", "topics", "keywords", "text", "hadithText", "hadithFullText", "explanationText", "explanationSourceUrl", "duplicates", "htmlIngestion")


def ingest_pages(pages: DataFrame, store: Snapshots, reports: str, topics: list[str], origins: list[str], source_id: str, limits: Limits = Limits(), prefix: str = "chunk-", parameter: str = "mainId") -> dict:
    """One run: pages are judged, merged and numbered into a new version, which is published if the run may be, else kept with the reports.

    Returns the row that the run adds to the ledger (reports/ledger). Rejected pages go to reports/failures (run_id, url, reason), the chunks of a run
    that isn't published to reports/rejected. The published version doesn't change unless the run is accepted, and then at once.

    Nulls: a null html is an empty page, null topics are none, a null title names no excerpt. No pages: a rejected run. Repeated pages
    merge into one chunk, whose duplicates count them. Pages need an ord of their own, by which the first of equal matns wins.
    """
    spark = pages.sparkSession
    run_id, seen = uuid.uuid4().hex, Observation()
    existing = store.rows()
    with Kept(spark) as kept:
        counted = [F.count(F.lit(1)).alias("pages"), F.count_if(F.col("reason").isNull()).alias("usable"), *(F.count_if(F.col("reason") == r).alias(f"r{k}") for k, r in enumerate(REASONS))]
        judged = kept(verdicts(pages, origins, parameter).observe(seen, *counted), "verdicts")
        full = F.coalesce("hadithFullText", F.lit("")) != ""
        version, made = store.stage(chunks_of(judged.where("reason is null"), source_id, prefix), full=F.count_if(full), explanations=F.count_if(F.coalesce("explanationText", F.lit("")) != ""), duplicates=F.coalesce(F.sum("duplicates"), F.lit(0)), **{f"t{k}": F.count_if(F.array_contains("topics", t)) for k, t in enumerate(topics)})
        judged.where("reason is not null").select(F.lit(run_id).alias("run_id"), "url", "reason").write.mode("append").parquet(f"{reports}/failures")
    per_topic = {t: made[f"t{k}"] for k, t in enumerate(topics)}
    weak = sum(n < limits.topic for n in per_topic.values())
    n = lambda v: F.lit(v).cast("long")
    reason = spark.range(1).select(ingest.assess(n(made["rows"]), n(weak), n(existing), limits.rows, limits.shrink_ok, n(made["full"]))).first()[0]
    if reason is None and not made["rows"]:
        reason = "too-few-rows"
    if reason is None:
        store.point(version, made["rows"], {"run_id": run_id})
    else:
        spark.read.parquet(f"{store.path}/{version}").withColumns({"run_id": F.lit(run_id), "rejected_because": F.lit(reason)}).write.mode("append").parquet(f"{reports}/rejected")
        store.drop(version)
    counts = seen.get
    row = {"run_id": run_id, "accepted": reason is None, "reason": reason, "version": version if reason is None else None, "pages": counts["pages"], "usable": counts["usable"], "chunks": made["rows"], "duplicates": made["duplicates"], "full_texts": made["full"], "explanations": made["explanations"], "failures": {r: counts[f"r{k}"] for k, r in enumerate(REASONS) if counts[f"r{k}"]}, "topics": per_topic}
    spark.createDataFrame([(*row.values(), None)], LEDGER).withColumn("finished_at", F.current_timestamp()).write.mode("append").parquet(f"{reports}/ledger")
    return row


def report(signals: DataFrame, cases_total: int, folder: str) -> dict:
    """Write an evaluation's cases (rows of evaluation.signals()) and its totals: folder/cases and folder/runs, keyed by run_id.

    The totals are observed while the cases are written. A run of fewer than cases_total cases is partial, and takes no part in latest().
    """
    run_id, seen = uuid.uuid4().hex, Observation()
    ai = F.col("mode") == "ai"
    share = lambda c: F.avg(F.when(ai, F.col(c).cast("double")))
    refusal = F.col("type").isin(*evaluation.REFUSALS)
    figures = {
        "cases": F.count_if(ai), "outcome_accuracy": share("outcome_correct"), "baseline_outcome_accuracy": F.avg(F.when(F.col("mode") == "baseline", F.col("outcome_correct").cast("double"))),
        "source_recall": share("source_recall"), "source_hit": F.avg(F.when(ai, (F.col("source_recall") > 0).cast("double"))), "chunk_recall": share("chunk_recall"),
        "abstention_accuracy": F.avg(F.when(ai & refusal, F.col("outcome_correct").cast("double"))),
    }
    signals.withColumn("run_id", F.lit(run_id)).observe(seen, *(c.alias(n) for n, c in figures.items())).write.mode("append").parquet(f"{folder}/cases")
    row = {"run_id": run_id, **seen.get, "complete": seen.get["cases"] == cases_total}
    kinds = ", ".join(f"{n} {'string' if n == 'run_id' else 'boolean' if n == 'complete' else 'long' if n == 'cases' else 'double'}" for n in row)
    signals.sparkSession.createDataFrame([(*row.values(), None)], f"{kinds}, finished_at timestamp").withColumn("finished_at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/runs")
    return row


def latest(spark, folder: str) -> DataFrame:
    """The last complete run's totals."""
    runs = spark.read.parquet(f"{folder}/runs").where("complete")
    return runs.orderBy(F.desc("finished_at"), "run_id").limit(1)
