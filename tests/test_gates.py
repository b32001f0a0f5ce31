import pytest
from pyspark.sql import functions as F

from corvid.operators import crisis, gates

#: A sentence of our own for each way to fire: markers, patterns, then one for each composed rule.
CRISIS = (
    "صرت أفكر إني اقتل نفسي هالليلة", "sometimes I plan to end my life", "there is no point in living like this", "من زمان وأنا أتمنى أن أموت", "ليتها نومه ما بعدها قيام", "محتاج انام واموت بهدوء",
    "عايز ارحل عن هذا العالم", "عاوز انهي وجودي", "مو مشتهي اعيش معهم", "لن اقدر ان استمر", "لن اعيش في هذا العالم", "ليس عندي سبب كي اعيش", "ليس هناك هدف في حياتي", "اهرب من هذا الكون",
    "سوف اتحرر نهائيا", "صرت عاله ولازم اتلاشى", "انا حمل ثقيل على امي", "كل عائلتي تراني عاله", "راح اطعن نفسي", "علمني اسرع وسيله عشان اموت", "بلعت اقراص كثيرة لكي ارتاح", "عندي سم يكفي لكي اموت",
    "جهزت كل شي قبل ان اموت", "عمري صار بلا طعم", "انا مخنوق من هالدنيا", "قرفت من عمري", "قررت انهي كل شي", "نويت اموت الليلة", "ما أبي أموت بس راح اطعن نفسي",
)
#: Research words, negation and other people exempt; the rest names no rule.
RESEARCH = (
    "كتاب عن سكرات الموت", "فضل تذكر الموت عند السلف", "شرح حديث الميت في القبر", "نفسي تطمئن بالقرآن", "الصبر عند المصيبة", "أتمنى موت الظالم", "لا أرغب في الموت", "قصص عن احتضار الصالحين",
    "دراسة طرق الوعظ بالموت", "راحة البال في الصلاة", "العالم ورث الأنبياء", "a question about patience", "   ",
)
CASES = {
    "prescription": (("كم قرص مهدئ في اليوم", "حدد لي عدد الحبوب", "ممكن اشرب شي ضد الأرق", "how many pills per day", "اكتب لي روشتة"), ("كم ركعة في صلاة الليل؟", "ماذا قال العلماء في الحسد؟", "عدد سور القرآن", "دواء الغفلة كثرة الذكر")),
    "diagnosis": (("اعتقد أن عندي قلق", "وش مرضي بالضبط", "هل أنا طبيعي أم لا"), ("ما سبب ضيق الصدر؟", "كيف يطمئن القلب")),
    "ruling": (("حكم صيام المسافر", "هل التدخين مكروه؟", "ايش حكم القزع", "وقع الطلاق بيننا أمس"), ("حكم في لغة العرب", "هل يزيد الإيمان بالطاعة")),
}


@pytest.mark.parametrize("phrases,want", [(CRISIS, True), (RESEARCH, False)])
def test_risk(spark, phrases, want):
    df = spark.createDataFrame([(p,) for p in phrases], "q string")
    assert [r["q"] for r in df.withColumn("r", crisis.detect_risk("q")).where(F.col("r") != want).collect()] == []


@pytest.mark.parametrize("gate", sorted(CASES))
def test_gate(spark, gate):
    rows = [(p, want) for phrases, want in zip(CASES[gate], (True, False), strict=True) for p in phrases]
    df = spark.createDataFrame(rows, "q string, want boolean")
    assert [r["q"] for r in df.withColumn("got", getattr(gates, gate)("q")).where("got <> want").collect()] == []


def test_cascade_order_and_outcomes(spark):
    rows = [(1, "كي"), (2, None), (3, "نويت اموت الليلة"), (4, "هل أنا طبيعي"), (5, "ايش حكم القزع"), (6, "كم قرص مهدئ في اليوم"), (7, "انسخ صفحة ٣٠ كاملة"), (8, "الرجاء بالله"), (9, "ايش حكم القزع ونويت اموت الليلة")]
    got = {r["id"]: (r["gate"], r["outcome"]) for r in gates.outcome(spark.createDataFrame(rows, "id int, query string")).collect()}
    assert got == {1: ("invalid", "invalid"), 2: ("invalid", "invalid"), 3: ("safety", "safety"), 4: ("diagnosis", "abstained"), 5: ("ruling", "fatwa"), 6: ("prescription", "abstained"), 7: ("full-page", "abstained"), 8: (None, None), 9: ("safety", "safety")}


def test_matter_is_the_first_of_the_list(spark):
    df = spark.createDataFrame([("زكاة المال وتركة الجد",), ("موعظة",)], "q string")
    assert [r[0] for r in df.select(gates.ruling_matter("q")).collect()] == ["مسألة في الميراث", None]


def test_lists_are_in_search_form():
    from corvid.functions.text import py_search_form

    for name, group in crisis.GROUPS.items():
        assert [w for w in group if py_search_form(w) != w] == [], name
