import pytest
from pyspark.sql import functions as F

from corvid.functions import html as H
from corvid.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "form"), [
    ("البَلاءُ؟ والصبرُ", "البلاء والصبر"), ("أإآٱ ؤ ئ ى ة", "اااا و ي ي ه"), ("Ça  ﻿ X1é", "a x1"), ("", ""), ("كتــاب", "كتاب"),
])
def test_search_form(spark, text, form):
    assert one(spark, text, X.search_form) == form == X.py_search_form(text)


def test_normal_forms_differ(spark):
    assert one(spark, "ؤ 12 a ى،", X.match_form) == "ؤ ي"
    assert one(spark, "ؤ ى،", X.dedupe_form) == "ؤ ي،"


def test_tokens_and_stems(spark):
    assert one(spark, "في القلب من والذنوب بالقلب", X.tokens) == ["قلب", "ذنوب", "قلب"]
    stem = lambda t: one(spark, t, X.canonical)
    assert [stem(t) for t in ("والقلب", "قلوبهم", "يضيق", "الله", "مكتوب", "ذنوبنا")] == ["قلب", "قلوب", "ضيق", "الل", "مكتوب", "ذنوب"]


def test_dialect_rewrites_whole_words_in_order(spark):
    assert one(spark, "مش عايز", X.rewrite_dialect) == "ليس أريد"
    assert one(spark, "مشكلة", X.rewrite_dialect) == "مشكلة"
    assert one(spark, "كيف نقدر", X.rewrite_dialect) == "كيف نستطيع"


def test_grounding_needs_two_adjacent_words(spark):
    df = spark.createDataFrame([("التوبة النصوح", "باب التَّوبةِ النصوح لله", True), ("التوبة", "التوبة", False), ("النصوح التوبة", "التوبة النصوح", False), (None, "x", False)], "e string, t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", X.grounded("e", "t").alias("got")).collect())


def test_commentary_is_found_after_the_first_line(spark):
    assert one(spark, "متن الحديث\nقوله: كذا", X.carries_commentary)
    assert not one(spark, "قوله: كذا\nسطر", X.carries_commentary)
    assert not one(spark, None, X.carries_commentary)


def test_strict_output(spark):
    assert one(spark, " نص  عربي. ", X.strict_output) == "نص عربي."
    assert [one(spark, t, X.strict_output) for t in ("", "نص x", "١٢", "漢 نص", "نص <b>")] == [None] * 5


def test_first_sentences(spark):
    assert one(spark, "جملة أولى. ثانية, تتمة! ثالثة", X.first_sentences) == "جملة أولى؛ ثانية، تتمة؛"
    assert one(spark, " . ", X.first_sentences) == ""


def test_framing(spark):
    assert one(spark, "هذا تشخيص حالتك", X.forbidden_framing) == ["تشخيص حالتك"]


@pytest.mark.parametrize(("raw", "text"), [
    ("&amp;amp;lt;", "<"), ("&#65;&#x42;", "AB"), ("&#xD800;", "�"), ("&amp ", "& "), ("&ampersand=2", "&ampersand=2"), ("&unknown;", "&unknown;"), ("plain", "plain"),
])
def test_entities(spark, raw, text):
    assert one(spark, raw, H.decode_entities) == text


def test_clean(spark):
    page = "<p>a&nbsp; b</p><script>x</script><p>c <a href='u'>d</a></p>![i](u) [l](http://x/y) http://z"
    assert one(spark, page, H.clean) == "a b\nc d\nl"


def test_urls(spark):
    df = spark.createDataFrame([("?a=1&amp;b=2", "http://h/p"), ("#x", "http://h/"), ("mailto:a@b", "http://h/"), ("//o/x", "https://h/"), (None, "http://h/")], "h string, b string")
    assert [r[0] for r in df.select(H.absolute_url("h", "b")).collect()] == ["http://h/p?a=1&b=2", None, None, "https://o/x", None]


def test_split_commentary(spark):
    matn = "حدثنا عبد الله قال سمعت رسول الله صلى الله عليه وسلم يقول في الحديث الصحيح كلاما"
    r = one(spark, matn + "\nقوله: شرح الكلام", H.split_commentary)
    assert r["matn"] == matn and r["commentary"].startswith("قوله") and r["cut"]
    r = one(spark, matn + " مطابقته للترجمة ظاهرة", H.split_commentary)
    assert r["matn"] == matn and r["cut"]
    assert not one(spark, matn, H.split_commentary)["cut"]


def test_error_categories(spark):
    got = [one(spark, m, H.error_category) for m in ("HTTP 503 x", "Timeout", "fetch failed", "other")]
    assert got == ["http-503", "timeout", "network", "error"]
    assert [one(spark, c, H.retryable) for c in ("http-503", "http-429", "http-404", "timeout", "error")] == [True, True, False, True, False]


def test_runs_of_other_characters_are_one_blank(spark):
    import random
    import re

    rng = random.Random(5)
    texts = ["".join(rng.choice("aZ7  ,\t\n\u00a0\u200b\u0628\u064b\u060c\u0750") for _ in range(rng.randint(0, 25))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.search_form("t"), X.dedupe_form("t"), H.clean("t", tags=False)).collect()
    marks = lambda t: re.sub(f"[{X.WIDE_MARKS}]", "", t)
    for t, search, dedupe, clean in got:
        assert search == X.py_search_form(t)
        assert dedupe == re.sub("[^\u0600-\u06ff\u0750-\u077f]+", " ", marks(t)).strip(" ")
        x = re.sub(" ?\n ?", "\n", re.sub("[ \t\u00a0]+", " ", t.replace("\u200b", "")))
        assert clean == re.sub(r"(?a)^\s+|\s+\Z", "", re.sub("\n{3,}", "\n\n", x))
    assert "regexp_replace" in df.select(X.search_form("t"))._jdf.queryExecution().toString()


def test_entities_are_decoded_in_the_jvm_as_by_the_plain_reading(spark):
    import random

    rng = random.Random(6)
    bits = ("&", "amp", "&amp;", "#", "&#65;", "&#x41", "&#xFEFF;", "&#55296;", "&#1114112;", "&#128512;", "&#0;", "&lt", "&LT;", "&nbsp", "&nosuch;", "&eacute;", "38;", "x26;", "\n", "a", "=", ";", "é")
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", H.decode_entities("t").alias("d"))
    assert [r["t"] for r in df.collect() if r["d"] != (None if r["t"] is None else H.py_decode(r["t"]))] == []
    assert "Python" not in df._jdf.queryExecution().toString()


def test_the_search_form_looks_characters_up(spark):
    odd = ["", " ", "a\u0000b\u0001c", "Été—Straße, ÇA", "İx Σς", "x\U0001f600中  y\U00010400z", "أًلـة، 9 ۔܀", "┏ a⁰b c"]
    x = spark.createDataFrame([(v,) for v in odd], "v string").select("v", X.search_form("v").alias("form"), X.tokens("v").alias("t"), X.token_set("v").alias("s"))
    for r in x.collect():
        assert r["form"] == X.py_search_form(r["v"]) and r["s"] == list(dict.fromkeys(r["t"]))
    # a search for a class of characters took four fifths of the time
    plan = x.select("form")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_the_search_form_searches_by_a_table_of_bits(spark):
    odd = ["", None, ". ً .", "ـ", "aً\u0000 ٰb", "KK İx", "été أ،9 7", "plain, ASCII\t text.", "׿؀ۿ܀", "x\U0001f600y ﻿"]
    x = spark.createDataFrame([(v,) for v in odd], "v string").select("v", X.search_form("v").alias("form"))
    for r in x.collect():
        assert r["form"] == (None if r["v"] is None else X.py_search_form(r["v"]))
    # every character went through two maps, and three with odd ones
    assert x._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
