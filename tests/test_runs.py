"""Ingestion and evaluation runs end to end."""

from pyspark.sql import functions as F

from corvid import sources as S
from corvid.operators import evaluation, runs

WORDS = "حدثنا محمد عبد الله قال سمعت رسول يقول كلاما طويلا الصبر والصلاة ذكر الناس عند باب الدار قولا حسنا".split()
PAGES = "ord long, url string, html string, title string, chapter string, topics array<string>"


def page(i, topics=("t1",), origin="http://h", matn=None):
    words = " ".join(WORDS[(i * k + k) % len(WORDS)] for k in range(1, 18)) + f" {WORDS[i % len(WORDS)] * 2} {'اب' * (i + 2)}"
    matn = matn or words
    own = f'<a href="?mainId={i}">x</a>' * 2
    return (i, f"{origin}/View?mainId={i}", f"<body>{own}<p>{i} - {matn}</p><p>* * *</p></body>", f"{i} - {' '.join(matn.split()[:6])}", "باب", list(topics))


def test_a_run_is_published_rejected_and_recorded(spark, tmp_path):
    store, reports = S.Snapshots(spark, f"{tmp_path}/corpus"), f"{tmp_path}/reports"
    go = lambda pages, **limits: runs.ingest_pages(spark.createDataFrame(pages, PAGES), store, reports, ["t1", "t2"], ["http://h/"], "site", runs.Limits(**limits))
    good = [page(i, ("t1", "t2")) for i in range(1, 13)]
    again = (50, *page(1, ("t3",))[1:])
    bad = [page(40, origin="http://other"), (41, "http://h/View?mainId=41", None, None, None, None), (42, "http://h/View?mainId=42", "<body>plain</body>", None, None, None), (43, "http://h/View?mainId=43", good[0][2], "x", "c", ["t1"])]
    first = go([*good, again, *bad], rows=10)
    assert first["accepted"] and first["pages"] == 17 and first["usable"] == 13 and first["chunks"] == 12 and first["duplicates"] == 1
    assert first["failures"] == {"not-allowed-origin": 1, "empty-response": 1, "no-arabic-content": 1, "page-does-not-reference-itself": 1}
    assert first["topics"] == {"t1": 12, "t2": 12} and store.state()["note"] == {"run_id": first["run_id"]}
    rows = {r["id"]: r for r in store.read().collect()}
    assert sorted(rows) == [f"chunk-{k:06}" for k in range(1, 13)] and rows["chunk-000001"]["topics"] == ["t1", "t2", "t3"]
    assert all(r["hadithText"] and r["sourceUrl"].startswith("http://h/") and r["role"] == "evidence" for r in rows.values())
    # a shrunk run, one with a thin topic, one with too few rows: the published version stays
    assert go(good[:5], rows=5)["reason"] == "shrunk"
    assert go([page(i) for i in range(1, 13)], rows=10)["reason"] == "weak-topics"
    assert go([], rows=10)["reason"] == "too-few-rows" and go([], rows=0, topic=0, shrink_ok=True)["reason"] == "too-few-rows"
    assert store.rows() == 12 and store.state()["note"] == {"run_id": first["run_id"]}
    ledger = spark.read.parquet(f"{reports}/ledger")
    assert ledger.count() == 5 and ledger.where("accepted").count() == 1
    assert {r[0] for r in spark.read.parquet(f"{reports}/rejected").select("rejected_because").distinct().collect()} == {"shrunk", "weak-topics"}
    assert spark.read.parquet(f"{reports}/failures").count() == 4
    second = go(good[:7], rows=5)
    assert second["accepted"] and store.rows() == 7


def test_an_evaluation_report(spark, tmp_path):
    folder = f"{tmp_path}/eval"
    cases = spark.createDataFrame([(1, "direct", "ok", ["a"], None, None), (2, "out-of-scope", "abstained", None, None, None)], "case_id long, type string, expected_outcome string, expected_sources array<string>, expected_chunks array<string>, expected_topics array<string>")
    results = spark.createDataFrame([(c, m, o, ["p"], s, [], "deterministic") for c, o, s in ((1, "ok", ["a", "b"]), (2, "ok", ["b"])) for m in ("ai", "baseline")], "case_id long, mode string, outcome string, passage_ids array<string>, source_ids array<string>, topic_ids array<string>, organization string")
    rows = evaluation.signals(cases, results)
    got = runs.report(rows, 2, folder)
    whole = evaluation.summary(rows).first()
    assert got["complete"] and got["cases"] == 2 and got["outcome_accuracy"] == whole["outcome_accuracy"] == 0.5 and got["source_recall"] == whole["retrieval_source_recall"] == 1.0 and got["abstention_accuracy"] == 0.0 and got["chunk_recall"] is None
    partial = runs.report(rows.where("case_id = 1"), 2, folder)
    assert not partial["complete"] and runs.latest(spark, folder).first()["run_id"] == got["run_id"]
    assert spark.read.parquet(f"{folder}/cases").groupBy("run_id").agg(F.count("*").alias("n")).orderBy("n").collect()[0]["n"] == 2
