"""Small operators on their edge cases: shapes, division, discovery, briefs, caps."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvid.operators import browse, crisis, ingest, shapes, substrings
from corvid.sources import Kept

GOOD = {
    "outcome": "ok", "query": "سؤال عن الصبر", "topics": [{"topic": {"id": "t1", "title": "الصبر"}, "score": 3}], "keywords": ["صبر"], "ai": {"mode": "deterministic", "text": "تنظيم"}, "disclaimer": "تنبيه", "message": None,
    "passages": [{"chunkId": "c1", "text": "نص", "chapter": "باب", "source": {"sourceId": "s1", "title": "كتاب", "author": "مؤلف", "originalUrl": "http://h/1"}}], "safety": None, "fatwa": None, "suggestions": [{"slug": "s", "title": "عنوان"}],
}


def test_response_shapes(spark):
    passage, source = GOOD["passages"][0], GOOD["passages"][0]["source"]
    cases = {
        "good": (GOOD, []),
        "none": (None, None),
        "text": ("just text", None),
        "list": ([], None),
        "outcome": (GOOD | {"outcome": "other"}, ["$.outcome"]),
        "number": (GOOD | {"outcome": 3}, ["$.outcome"]),
        "no arrays": (GOOD | {"passages": "x", "topics": {}, "suggestions": None}, ["$.passages", "$.suggestions", "$.topics"]),
        "keywords": (GOOD | {"keywords": ["a", 1]}, ["$.keywords[*]"]),
        "passage": (GOOD | {"passages": [passage, {**passage, "chunkId": 3}, "x"]}, [f"$.passages[*]{c}" for c in ("", ".chapter", ".chunkId", ".source", ".source.author", ".source.originalUrl", ".source.sourceId", ".source.title", ".text")]),
        "source": (GOOD | {"passages": [{**passage, "source": {**source, "author": None}}]}, ["$.passages[*].source.author"]),
        "mode": (GOOD | {"ai": {"mode": "magic", "text": None}}, ["$.ai.mode"]),
        "modeless": (GOOD | {"ai": {"mode": None, "text": None}}, []),
        "ai": (GOOD | {"ai": None}, ["$.ai", "$.ai.mode", "$.ai.text"]),
        "safety": ({k: v for k, v in GOOD.items() if k != "safety"}, ["$.safety"]),
        "suggestion": (GOOD | {"suggestions": [{"slug": "s"}]}, ["$.suggestions[*].title"]),
        "empty": (GOOD | {"topics": [], "keywords": [], "passages": [], "suggestions": []}, []),
    }
    rows = [(k, None if v is None else json.dumps(v)) for k, (v, _) in cases.items()] + [("broken", "{")]
    got = defaultdict(list)
    for r in shapes.violations(spark.createDataFrame(rows, "id string, body string"), ["id"], "body").collect():
        got[r["id"]].append(r["path"])
    for k, (_, want) in cases.items():
        assert (sorted(got[k]) == sorted(want)) if want is not None else ("$" in got[k]), (k, got[k])
    assert "$" in got["broken"]


def test_division_of_sets(spark):
    held = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "b"), ("h", "a"), ("h", None), (None, "a"), (None, "b")], "g string, m string")
    wanted = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c"), (4, None)], "k int, m string")
    got = sorted(map(str, map(tuple, browse.contains_all(held, "g", "m", wanted, "k").collect())))
    assert got == sorted(map(str, [("g", 1), ("h", 1), (None, 1), ("g", 2), (None, 2)]))
    assert browse.contains_all(held.limit(0), "g", "m", wanted, "k").count() == 0 and browse.contains_all(held, "g", "m", wanted.limit(0), "k").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_discovery_is_breadth_first(spark, seed):
    rng = random.Random(seed)
    landed = [f"p{i}" for i in range(40)]
    edges = [(rng.choice(landed), rng.choice([*landed, "gone"])) for _ in range(60)] + [("p1", "p1"), (None, "p2"), ("p3", None)]
    pages, links = spark.createDataFrame([(p,) for p in [*landed, None]], "url string"), spark.createDataFrame(edges, "source string, url string")
    seeds = spark.createDataFrame([("p0",), ("p0",), ("gone",)], "url string")
    want, level, d = {"p0": 0}, {"p0"}, 0
    while level and d < 4:
        d += 1
        level = {b for a, b in edges if a in level and b in landed and b not in want}
        want |= dict.fromkeys(level, d)
    with Kept(spark) as kept:
        assert {r["url"]: r["depth"] for r in ingest.discover(pages, links, seeds, depth=4, kept=kept).collect()} == want
        capped = {r["url"]: r["depth"] for r in ingest.discover(pages, links, seeds, most=5, depth=4, kept=kept).collect()}
        assert len(capped) == min(5, len(want)) and all(want[u] == k for u, k in capped.items())
        assert ingest.discover(pages, links, seeds.limit(0), kept=kept).count() == 0


def test_links_are_capped_in_page_order(spark):
    html = '<a href="/b">12 - ثانيا</a><a href="/a">أولا،</a><a href="/a">أولا</a><a href="http://o/x">خارج</a><a href="/c"> </a><a href="/d">latin</a><a href="/e">ثالثا</a><a href="/Service?serviceId=6">s</a><a href="/ViewServicePage">v</a>'
    df = spark.createDataFrame([(1, "http://h/p", html), (2, "http://h/q", None)], "id int, url string, html string")
    got = [tuple(r) for r in ingest.subject_links(df, "id", "url", "html", ["http://h/"], "/[a-e]$", most=2).orderBy("pos").collect()]
    assert got == [(1, 0, "http://h/b", "ثانيا"), (1, 1, "http://h/a", "أولا")]
    found = ingest.links(df, "id", "url", "html", ["http://h/"])
    assert [r["url"] for r in ingest.best_links(found, "id", "6", most=3).orderBy("rank").collect()] == ["http://h/Service?serviceId=6", "http://h/ViewServicePage", "http://h/b"]


def test_texts_for_people_and_models(spark):
    df = spark.createDataFrame([("قبل ﴿آية﴾ بعد﴿ثانية﴾",), ("بلا",), ("﴿مفتوح",), ("",), (None,)], "t string")
    assert [[(v["verse"], v["text"]) for v in r[0] or []] for r in df.select(browse.verse_parts("t")).collect()] == [[(False, "قبل "), (True, "﴿آية﴾"), (False, " بعد"), (True, "﴿ثانية﴾")], [(False, "بلا")], [(False, "﴿مفتوح")], [], []]
    df = spark.createDataFrame([("  ab  ",), (None,), ("x" * 2000,)], "t string")
    got = df.select(browse.embed_text("t").alias("a"), browse.embed_text("t", "document").alias("b")).collect()
    assert (got[0]["a"], got[0]["b"], got[1]["a"], len(got[2]["a"])) == ("ab", "title: none | text: ab", "", 1400)
    topics = spark.createDataFrame([("t2", "b", "ثان, له", 2), ("t1", "a", "أول", 1), ("t3", "c", "ثالث", 3)], "id string, slug string, title string, order int")
    assert [r["slug"] for r in browse.suggestions(topics, 2).collect()] == ["a", "b"]
    matched = spark.createDataFrame([(1, "t2", 1), (1, "t1", 2)], "query_id int, topic_id string, rank int")
    passages = spark.createDataFrame([(1, 1, None, None, "جملة أولى. ثانية. ثالثة", "باب, أول")], "query_id int, rank int, hadithText string, hadithFullText string, text string, chapter string")
    got = {r["query_id"]: r["brief"] for r in browse.brief(spark.createDataFrame([(1,), (2,)], "query_id int"), matched, topics, passages).collect()}
    assert got[1].split("\n") == [browse.BRIEF, "", browse.BRIEF_TOPICS, "• ثان، له", "• أول", "", browse.BRIEF_PASSAGES, "1. جملة أولى؛ ثانية؛ (الموضع: باب، أول)", "", browse.BRIEF_NOTE]
    assert got[2].split("\n") == [browse.BRIEF, "", browse.BRIEF_PASSAGES, "", browse.BRIEF_NOTE]


def test_keys_and_first_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "u"), (4, None, "u")], "n int, k string, u string")
    assert sorted(map(tuple, ingest.duplicate_keys(df, {"k": F.col("k"), "u": F.col("u")}).collect())) == [("k", "a", 2), ("u", "u", 2)]
    assert sorted(r["n"] for r in browse.distinct_by(df, F.col("k"), "n").collect()) == [1, 3, 4]
    assert {r["name"]: r["rows"] for r in browse.health(a=df, b=df.limit(0)).collect()} == {"a": 4, "b": 0}
    page = spark.createDataFrame([("<main>" + "كلام " * 30 + "</main>",), ("<main>قصير</main>",), ("<main>Just a moment " + "كلام " * 30 + "</main>",), (None,)], "p string")
    assert [r[0] for r in page.select(ingest.useful_page("p")).collect()] == [True, False, False, False]


def test_most_similar_vectors(spark, monkeypatch):
    monkeypatch.setattr(browse, "QUERY_BLOCK", 7)
    monkeypatch.setattr(browse, "VECTOR_BLOCK", 11)
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(50)] + [(60, [0.0] * 3), (61, []), (62, [1.0, 2.0]), (63, None), (None, [1.0] * 3), (64, [1.0] * 3), (65, [2.0] * 3), (66, [2.0] * 3)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = sorted(map(tuple, browse.cosine_topk(df, df.where("id % 5 = 0 or id > 59"), "id", "v", 3).select("query_id", "rank", "vec_id").collect()))
    x = df.alias("a").join(df.alias("b"), F.expr("a.id <> b.id and a.v is not null and b.v is not null")).where("a.id % 5 = 0 or a.id > 59")
    pairs = x.select(F.col("a.id").alias("q"), F.col("b.id").alias("i"), F.round(browse.cosine("a.v", "b.v"), 6).alias("s")).collect()
    want = []
    for q in {r["q"] for r in pairs}:
        want += [(q, n + 1, i) for n, (_, i) in enumerate(sorted((-r["s"], r["i"]) for r in pairs if r["q"] == q)[:3])]
    assert got == sorted(want)


def test_scores_of_a_block_are_not_held_at_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    side = lambda ids: pa.table({"id": pa.array(ids), "v": pa.array(list(rng.normal(size=(len(ids), 8)).astype("f4")))})
    left, right = side(np.arange(3000)), side(np.arange(8000))
    tracemalloc.start()
    got = browse.nearest_rows(left, right, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 6000 and peak < 100 << 20, peak  # all scores at once: 192 MB and their copies


def test_entries_that_never_fire(spark):
    said = spark.createDataFrame([("والموت يا فلان",), ("ما نموتش",), (None,), ("",)], "t string")
    dead = {(r["group"], r["word"]) for r in crisis.dead_entries(said, "t").collect()}
    listed = {(g, w) for g in crisis.GROUPS for w in crisis.GROUPS[g]}
    assert listed - dead == {("DEATH", "موت"), ("DEATH", "نموت"), ("OTHER_TARGET", "فلان"), *((g, "ما") for g in ("NEGATION", "NEGATION_OR_INABILITY"))}


def test_containment_equals_comparing_all_pairs(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(90, None), (91, ""), (92, "ab" * 30_000)]
    patterns = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(90, None), (91, "abababab"), (91, "abababab")]
    for least in (1, 4, 8):
        got = sorted((r["i"], r["j"]) for r in substrings.containing(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(patterns, "j int, p string"), "t", "p", least).collect())
        assert got == sorted((i, j) for i, t in texts for j, p in patterns if t and p and len(p) >= least and p in t)
    with pytest.raises(ValueError, match="column"):
        substrings.containing(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(texts, "i int, t string"), "t", "t")


def test_patterns_of_several_words_meet_whole_words(spark):
    rng = random.Random(8)
    words = ["abc", "bcd", "a", "", "cdef", "ab"]
    line = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    texts, patterns = [(i, line(12)) for i in range(80)], [(i, line(5)[rng.randint(0, 2) :]) for i in range(80)]
    t, p = spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(patterns, "j int, p string")
    got = sorted((r["i"], r["j"]) for r in substrings.containing(t, p, "t", "p").collect())
    assert got == sorted((i, j) for i, a in texts for j, b in patterns if b and b in a)
    plan = substrings.containing(t, spark.createDataFrame([(1, "ab cdef ab")], "j int, p string"), "t", "p")._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "transform" not in plan.split("Physical Plan")[1].split("Generate")[0]


def test_lines_collapse_where_they_lie(spark):
    rng = random.Random(9)
    line = lambda: rng.choice(("", "!!", "Short", "short,", "one  longer line", "One longer, line!", "another line here"))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 15)))) for i in range(60)] + [(90, None)]
    from corvid.functions.text import py_search_form, search_form

    df = ingest.collapse_repeats(spark.createDataFrame(rows, "i int, t string"), "i", "t", 10, search_form)
    want = {}
    for i, t in rows:
        seen, kept = set(), []
        for v in (t or "").split("\n"):
            k = py_search_form(v)
            if k and (len(k) < 10 or k not in seen):
                kept.append(v)
            seen.add(k)
        if kept:
            want[i] = "\n".join(kept)
    assert {r["i"]: r["text"] for r in df.collect()} == want
    assert "Exchange" not in df._jdf.queryExecution().toString()


def test_texts_are_made_once_to_be_searched(spark):
    from corvid.functions.text import search_form

    t = spark.createDataFrame([(1, "ab Cdef, ab"), (2, None), (3, "ab ab")], "i int, raw string").select("i", search_form("raw").alias("t"))
    x = substrings.containing(t, spark.createDataFrame([(1, "ab cdef ab"), (2, None)], "j int, p string"), "t", "p")
    assert [(r["i"], r["j"]) for r in x.collect()] == [(1, 1)]
    # the texts' form stood in a filter of its own besides
    assert x._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
