import pytest

from corvid import sources as S
from corvid.operators import browse, evaluation, ingest, registry, retrieval
from corvid.streaming import limiter

TAG = {"id": "tag", "sourceId": "s1", "chapter": "فصل", "excerptType": "curated-summary", "topics": ["t1"], "keywords": ["زاد المسافر وراحلته"], "text": "فقرة مطولة في آداب السفر ولباس المسافر وزاده في طريقه، وما يحمله من متاع حين يخرج من داره صباحا."}
LEX = {"id": "lex", "sourceId": "s1", "chapter": "فصل قسوة القلب", "excerptType": "literal", "topics": ["t1"], "keywords": ["قسوة القلب"], "text": "قسوة القلب داء يورث الغفلة، ودواؤه مجالسة الصالحين وكثرة الاستغفار وزيارة المرضى وإطعام المساكين."}
OTHER = {**LEX, "id": "other", "sourceId": "s2"}
SECOND = {**LEX, "id": "second", "text": LEX["text"] + " زيادة"}
HIDDEN = {**LEX, "id": "hidden", "sourceId": "s3"}
SOURCES = [{"id": i, "slug": i, "title": t, "author": a, "status": st} for i, t, a, st in (("s1", "كتاب الداء", "الإمام ابن القيم", "active"), ("s2", "جامع السنة", "عبدالرحمن الحازمي", "active"), ("s3", "كتاب ممنوع", "فلان", "active"), ("s4", "قديم", "فلان", "draft"))]
TOPICS = [{"id": "t1", "slug": "t1", "order": 1, "title": "قسوة القلب", "synonyms": ["قسوة القلب"], "keywords": ["القسوة", "القلب"], "related": ["t2", "zz"]}, {"id": "t2", "slug": "t2", "order": 2, "title": "التوبة", "synonyms": ["التوبة", "هم"], "keywords": ["التوبة"], "related": []}]


def world(spark, chunks):
    return S.rows(spark, chunks, S.CHUNKS), S.rows(spark, SOURCES, S.SOURCES), S.rows(spark, [{"title": "ممنوع"}], S.EXCLUDED), S.rows(spark, TOPICS, S.TOPICS)


def ask(spark, chunks, *queries):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    return {(r["query_id"], r["rank"]): r["chunkId"] for r in retrieval.retrieve(q, *world(spark, chunks)).collect()}


def test_a_tag_without_evidence_finds_nothing(spark):
    assert ask(spark, [TAG], "قسوة القلب") == {}


def test_evidence_is_found_and_sources_take_turns(spark):
    got = ask(spark, [TAG, LEX, SECOND, OTHER, HIDDEN], "قسوة القلب", "كيف أصلح عجلة دراجتي", None)
    assert got == {(0, 1): "lex", (0, 2): "other", (0, 3): "second"}


def test_a_named_author_restricts_the_sources(spark):
    assert set(ask(spark, [LEX, OTHER], "قول الحازمي في قسوة القلب").values()) == {"other"}
    assert ask(spark, [LEX, OTHER], "قول العلماء في قسوة القلب") == {}


def test_topics_keywords_and_pipeline(spark):
    chunks, src, ex, topics = world(spark, [LEX, OTHER])
    q = spark.createDataFrame([(0, "قسوة القلب"), (1, "هم"), (2, "أبغى الموت"), (3, "موضوع بعيد جدا")], "query_id long, query string")
    got = {(r["query_id"], r["topic_id"]): r["score"] for r in retrieval.topics_of(q, topics).collect()}
    assert got == {(0, "t1"): 3, (1, "t2"): 2} or got == {(0, "t1"): 3}
    out = {r["query_id"]: r for r in retrieval.run_research(q, chunks, src, ex, topics).collect()}
    assert (out[0]["outcome"], out[0]["passage_ids"], out[0]["topic_ids"]) == ("ok", ["lex", "other"], ["t1"])
    assert "القلب" in out[0]["keywords"] and out[2]["outcome"] == "safety" and out[3]["outcome"] == "abstained"
    assert out[1]["outcome"] == "invalid"


def test_registry(spark):
    _, src, ex, topics = world(spark, [])
    assert {r["id"] for r in registry.retrievable(src, ex).collect()} == {"s1", "s2"}
    assert [tuple(r) for r in registry.related(topics).collect()] == [("t1", 0, "t2")]


def test_passage_hides_what_is_not_a_matn(spark):
    bad = {**LEX, "hadithFullText": "متن\nقوله: شرح", "hadithText": "متن"}
    good = {**LEX, "id": "g", "hadithFullText": "متن الحديث كاملا", "hadithText": "متن الحديث"}
    chunks, src, ex, _ = world(spark, [bad, good])
    got = {r["chunkId"]: (r["hadithFullText"], r["hadithText"], r["citationStatus"]) for r in registry.passages(chunks, src, ex).collect()}
    assert got == {"lex": (None, None, "chapter-only"), "g": ("متن الحديث كاملا", "متن الحديث", "chapter-only")}


def test_merge_extends_topics_and_keywords_in_turn(spark):
    matn = "حدثنا محمد قال سمعت النبي يقول كلاما طويلا يكفي للعتبة المقررة هنا وزيادة"
    rows = [(0, "عنوان أول", "", matn, "", ["a"]), (1, "عنوان ثاني", "", matn + "!", "", ["b", "a"]), (2, "مكرر تماما", "", matn, "", ["a"]), (3, "x", "short", "", "", ["a"]), (4, "غيره", matn + " آخر مختلف", "", "", ["c"])]
    got = ingest.merge(spark.createDataFrame(rows, "ord long, title string, text string, hadithFullText string, explanationText string, topics array<string>")).orderBy("ord").collect()
    assert [(r["id"], r["topics"], r["duplicates"]) for r in got] == [("chunk-000001", ["a", "b"], 2), ("chunk-000002", ["c"], 0)]
    assert got[0]["keywords"] == ["عنوان", "a", "ثاني", "b"]


def test_assessment_order(spark):
    from pyspark.sql import functions as F

    rows = [(5, 0, 0, "too-few-rows"), (20, 1, 100, "weak-topics"), (20, 0, 100, "shrunk"), (50, 0, 100, None), (20, 0, 5, None)]
    df = spark.createDataFrame(rows, "n int, weak int, existing int, want string")
    assert df.where(~ingest.assess(F.col("n"), F.col("weak"), F.col("existing"), 10).eqNullSafe(F.col("want"))).count() == 0


def test_recall_is_null_without_expectation(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), ([], ["a"]), (None, None)], "e array<string>, g array<string>")
    assert [r[0] for r in df.select(evaluation.recall("e", "g")).collect()] == [0.5, None, None]


def test_conflict_keeps_the_quirk_of_negated_phrases(spark):
    df = spark.createDataFrame([(1, "a", "not permitted"), (2, "b", "forbidden")], "ord long, source_id string, text string")
    r = evaluation.conflicts(df).first()
    assert (r["positive"], r["negative"]) == (1, 2)


def test_limiter_boundary_and_retry(spark):
    from datetime import datetime, timedelta

    start = datetime(2026, 1, 1, 0, 0, 0)
    rows = [(k, "c", start + timedelta(seconds=k)) for k in range(31)] + [(99, "c", start + timedelta(seconds=61))]
    got = {r["id"]: r for r in limiter.decide(spark.createDataFrame(rows, "id long, key string, ts timestamp"), "key", "ts", "id").collect()}
    assert got[29]["allowed"] and got[29]["remaining"] == 0 and not got[30]["allowed"] and got[30]["retry_after_seconds"] == 30 and got[99]["allowed"]


@pytest.mark.parametrize(("header", "hops", "want"), [("1.1.1.1, 2.2.2.2", 1, "2.2.2.2"), ("1.1.1.1, 2.2.2.2", 5, "1.1.1.1"), (" , ", 1, "unknown"), (None, 1, "unknown")])
def test_client_ip(spark, header, hops, want):
    assert spark.createDataFrame([(header,)], "h string").select(limiter.client_ip("h", hops=hops)).first()[0] == want


def test_hmac(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("1.2.3.4",)], "ip string").select(limiter.client_key("k" * 80, "ip")).first()[0]
    assert got == hmac.new(b"k" * 80, b"rate-limit|1.2.3.4", hashlib.sha256).hexdigest()


def test_questionnaire(spark):
    areas = spark.createDataFrame([("a", ["t2"])], "id string, topicIds array<string>")
    refinements = spark.createDataFrame([(0, "r1", "a", "t1", ["k1", "k2"]), (1, "r2", "a", "t2", ["k2"])], "ord int, id string, areaId string, topicId string, keywords array<string>")
    picks = spark.createDataFrame([(1, "a", ["r1", "r2"]), (2, "a", []), (3, "x", [])], "path_id int, area_id string, refinement_ids array<string>")
    got = {r["path_id"]: (r["topic_ids"], r["keywords"]) for r in browse.questionnaire(areas, refinements, picks, S.rows(spark, TOPICS, S.TOPICS)).collect()}
    assert got == {1: (["t1", "t2"], ["k1", "k2"]), 2: (["t2"], ["التوبة"])}
    assert browse.all_paths(areas, refinements).count() == 4


def test_overlap_pairs_cover_every_needle(spark):
    texts = [(0, "alpha beta gamma alpha"), (0, "beta, delta"), (41, "omega"), (None, "alpha"), (7, None)]
    needles = [(3, "alpha beta alpha zeta"), (150, "Omega"), (199, "a b"), (200, None)]
    got = retrieval.overlap_pairs(spark.createDataFrame(needles, "item_id long, q string"), spark.createDataFrame(texts, "doc_id long, text string"), "item_id", "q", "doc_id", "text")
    want = [(3, 0, 0.75), (3, 0, 0.25), (3, None, 0.5), (150, 41, 1.0), *((199, i, 1.0) for i, _ in texts)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_dense_ids_cover_the_whole_table(spark):
    x = spark.range(0, 1_000_050, 1, 4).selectExpr("id AS ord").unionByName(spark.createDataFrame([(None,)], "ord long"))
    got = {r["ord"]: r["id"] for r in ingest._numbered(x, "doc-").where("ord is null or ord in (0, 65535, 65536, 999998, 999999)").collect()}
    assert got == {0: "doc-000001", 65535: "doc-065536", 65536: "doc-065537", 999998: "doc-999999", 999999: "doc-1000000", None: "doc-1000051"}
    split = browse.display_split(spark.range(30).selectExpr("nullif(id, 29) AS doc_id"), "doc_id").collect()
    assert len(split) == 30 and {r["doc_id"] for r in split if not r["compact"]} == set(range(24))


def rules_of(df):
    return sorted(r["rule"] for r in df.collect())


def test_full_text_gate_and_distinct_texts(spark):
    from pyspark.sql import functions as F

    rows = [(100, 50, "few-full-texts"), (100, 89, "few-full-texts"), (100, 90, None), (99, 0, None), (200, None, "few-full-texts")]
    df = spark.createDataFrame(rows, "n int, full int, want string")
    assert df.where(~ingest.assess(F.col("n"), F.lit(0), F.lit(0), 10, full=F.col("full")).eqNullSafe(F.col("want"))).count() == 0
    x = spark.createDataFrame([(0, "a", "one  two"), (1, "a", " one\n\u00a0two "), (2, "b", "one two"), (3, "b", " "), (4, "b", None)], "ord long, sourceId string, text string")
    assert x.agg(ingest.full_texts("text")).first()[0] == 4
    kept = ingest.distinct_texts(x, "ord")
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2]
    least = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "sourceId string, minimum int")
    assert sorted(map(tuple, ingest.short_sources(kept, least).collect())) == [("b", 1, 2), ("c", 0, 1)]


def test_manifest_provenance_and_routing_rules(spark):
    site, ids = "https://site.example/", [f"t{i}" for i in range(12)]
    schema = "sourceId string, baseUrl string, targets array<struct<url string, topicIds array<string>>>, requiredTopicIds array<string>, allowedOrigins array<string>, minimumChunks int, minimumChunksPerTopic int, maxSubjectResults int, fetchAttempts int"
    good = ("s", site, [(site + "x", ["t1"])] * 8, ids, None, 100, 3, 28, None)
    bad = ("z", None, [("http://other/", ["t1"]), (site, []), (site, ["no"])], ids[:5], [site, site], 99, 2, 27, 0)
    check = lambda row: rules_of(ingest.manifest_violations(spark.createDataFrame([row], schema), "s", site))
    assert check(good) == [] and len(check(bad)) == 12 and check((*good[:2], None, *good[3:])) == ["too few targets"]
    schema = "ord long, id string, sourceId string, text string, excerptType string, role string, sourceUrl string, chapter string, sourceFile string, docling struct<documentHash string, sourceFile string, headings array<string>>"
    rows = [(0, "a", "s", "t", "literal", "evidence", site, "c", "f.pdf", ("h", None, None)), (1, "b", "s", "t", "literal", "index", site, "", "http://other/x", (None, None, [])), (2, "c", None, "t", "literal", "index", site, "", None, ("h", None, None))]
    got = {(r["id"], r["rule"]) for r in ingest.provenance_violations(spark.createDataFrame(rows, schema), site).collect()}
    assert got == {("b", "role"), ("b", "document provenance"), ("b", "heading provenance"), ("b", "input not official"), ("c", "missing sourceId")}
    topics = spark.createDataFrame([("t1",), ("t2",)], "id string")
    chunks = lambda n, role, url: spark.createDataFrame([(["t1"], role, url)] * n, "topics array<string>, role string, sourceUrl string")
    assert rules_of(ingest.routing_violations(chunks(2, "evidence", "http://other/"), topics, site)) == ["missing topic", "no index role", "too few entries", "url not official", "url not official"]
    assert rules_of(ingest.routing_violations(chunks(100, "index", site), topics.where("id = 't1'"), site)) == []


def test_later_rows_of_a_source_go_before_the_shuffle(spark):
    import re

    from corvid.operators import retrieval

    x = retrieval.diversified(spark.range(600).selectExpr("id % 3 AS q", "id * id % 5 AS s", "CAST(id * 7 % 11 AS DOUBLE) AS v", "id AS d"), "q", "s", "v", "d", 3)
    assert re.search(r"WindowGroupLimit \[q#\d+L?, s#\d+L?\]", x._jdf.queryExecution().executedPlan().toString())
    rows = [(i % 3, i * i % 5, i * 7 % 11, i) for i in range(600)]
    want = []
    for q in range(3):
        seen, ranked = set(), []
        for _, s, v, d in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[3])):
            ranked.append((s in seen, -v, d))
            seen.add(s)
        want += [(q, n + 1, d) for n, (_, _, d) in enumerate(sorted(ranked)[:3])]
    assert sorted((r["q"], r["rank"], r["d"]) for r in x.collect()) == want
