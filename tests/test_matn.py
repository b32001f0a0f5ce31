import random

from pyspark.sql import functions as F

from corvid.functions import matn as C

from . import plain_matn as M

MATN = "حدثنا محمد بن عبد الله قال سمعت رسول الله صلى الله عليه وسلم يقول إنما الأعمال بالنيات"
PAGE = f'<body><a href="?mainId=7">x</a><a href="?mainId=7">y</a><p>إضافة تعليق</p><p>12 - {MATN}</p><p>{MATN}</p><p>* * *</p><p>مطابقته للترجمة ظاهرة وفيه من الفوائد ما لا يخفى على من تأمل هذا الحديث الجليل العظيم</p></body>'


def test_detail_page_gives_matn_once_and_its_explanation():
    r = M.detail(PAGE, "http://h/View?mainId=7", "3 - سمعت رسول الله صلى الله عليه وسلم<br>صحيح مسلم")
    assert r["reason"] is None and r["number"] == "12" and r["matn"] == MATN or r["matn"].split("\n")[0] == MATN
    assert r["explanation"].startswith("مطابقته للترجمة")


def test_reasons_in_order():
    reason = lambda page, url="http://h/?x=1", title="": M.detail(page, url, title)["reason"]
    assert reason(None) == "empty-response"
    assert reason("<body>Just a moment</body>") == "block-page"
    assert reason("<body>plain</body>") == "no-arabic-content"
    assert reason("<body>الصفحة غير موجودة</body>") == "site-error-page"
    assert reason(PAGE, "http://h/?mainId=8") == "page-does-not-reference-mainId-8"
    assert reason("<body>كلام عربي بلا رقم</body>") == "no-matn-extracted"
    assert reason("<body><p>5 - حدثنا محمد قال سمعت النبي يقول هذا كلام قصير</p></body>") == "matn-too-short"
    assert reason(PAGE, "http://h/", "كلمات أخرى لا توجد هناك أبدا") == "matn-does-not-match-result-excerpt"


def test_commentary_page():
    body = "مطابقته للترجمة " + "شرح مفيد للحديث الشريف " * 20
    assert M.commentary(f"<body>{body}</body>", None)["explanation"].startswith("مطابقته")
    assert M.commentary("<body>قصير</body>", None)["reason"] == "not-a-commentary-page"
    assert M.commentary(f"<body>{'كلام عام ' * 60}</body>", None)["reason"] == "no-commentary-markers"


def test_snippet():
    assert M.snippet("12 - إنما الأعمال بالنيات، صحيح البخاري") == "إنما الأعمال بالنيات"
    assert M.snippet("") == ""


def test_columns(spark):
    df = spark.createDataFrame([(PAGE, "http://h/View?mainId=7", None), (None, None, None)], "p string, u string, t string")
    assert [r[0]["reason"] for r in df.select(C.detail_page("p", "u", "t")).collect()] == [None, "empty-response"]
    assert df.select(C.commentary_page("p", "u")).count() == 2


def test_tidy_equals_the_column(spark):
    from corvid.functions import html as H

    pages = [PAGE, "<p>a&nbsp; b</p>![i](u) [l](http://x/y)\n\n\n\nz", "", "&amp;amp;#65;"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "p string").select(H.clean("p")).collect()]
    assert got == [M.tidy(p) for p in pages]


WORDS = "حدثنا محمد عبد الله قال سمعت رسول يقول كلاما طويلا في الصبر والصلاة ثم ذكر الناس عند باب الدار قولا حسنا".split()


def pages(rng, n):
    """Pages of numbered lines, repeats, noise, separators and commentary in any order, with a title that is like some line or none."""
    for _ in range(n):
        lines = []
        for _ in range(rng.randint(0, 12)):
            body = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 22)))
            kind = rng.random()
            lines.append(f"{rng.randint(1, 99)}{rng.choice((' - ', '-', ' – '))}{body}" if kind < 0.3 else "* * *" if kind < 0.37 else f"مطابقته للترجمة: {body}" if kind < 0.45 else "إضافة تعليق" if kind < 0.5 else "plain words" if kind < 0.55 else rng.choice(lines) if lines and kind < 0.7 else body)
        if rng.random() < 0.3:
            lines.append("ذكر معناه " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 120))) + rng.choice(("", " تحليل الحديث روابط", " الرواة")))
        like = rng.choice(lines) if lines else ""
        title = rng.choice(("", like, " ".join(like.split()[2:9]), "12 - " + " ".join(rng.choice(WORDS) for _ in range(5)) + "<br>صحيح البخاري", "غير موجود هنا البتة"))
        own = "".join('<a href="?mainId=7">x</a>' for _ in range(rng.randint(1, 3)))
        yield f"<body>{own}" + "".join(f"<p>{v}</p>" for v in lines) + "</body>", rng.choice((None, "http://h/View?mainId=7", "http://h/View?mainId=8")), title


def test_columns_equal_reading_line_by_line(spark):
    rows = [*pages(random.Random(3), 700), (PAGE, "http://h/View?mainId=7", "3 - سمعت رسول الله صلى الله عليه وسلم<br>صحيح مسلم"), ("", None, None), (None, None, None), ("<body>Just a moment</body>", None, None)]
    df = spark.createDataFrame(rows, "p string, u string, t string").repartition(4)
    got = df.select("*", C.detail_page("p", "u", "t").alias("d"), C.commentary_page("p", "u").alias("c")).collect()
    bad = [(r["p"], r["t"], r["d"].asDict(), want) for r in got if r["d"].asDict() != (want := {k: v for k, v in M.detail(r["p"], r["u"], r["t"]).items() if k in ("reason", "number", "matn", "explanation")})]
    assert bad == [], bad[0]
    assert [r["p"] for r in got if r["c"].asDict() != M.commentary(r["p"], r["u"])] == []
    reasons = {r["d"]["reason"] for r in got} | {r["c"]["reason"] for r in got}
    assert {None, "no-matn-extracted", "matn-too-short", "matn-does-not-match-result-excerpt", "no-commentary-markers", "no-explanation-extracted", "not-a-commentary-page"} <= reasons, reasons


def test_extraction_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("12 - " + " ".join(WORDS),)], "t string").select(C.extract(F.col("t"), F.lit("")).alias("x"))
    assert "Python" not in df._jdf.queryExecution().toString() and df.first()["x"]["number"] == "12"
