"""The crisis rules as columns against the same rules read token by token."""

import random

from pyspark.sql import functions as F

from corvid.operators import crisis

from . import plain_crisis as plain

NEUTRAL = ("قال", "يوم", "بيت", "في", "من", "ثم", "word", "قلم", "سماء")


def test_shape_patterns_are_the_shapes():
    import re

    rng = random.Random(1)
    groups = {g: re.compile(crisis.shape_pattern(crisis.GROUPS[g])) for g in crisis.GROUPS}
    words = [w for g in crisis.GROUPS.values() for w in g if " " not in w]
    for _ in range(3000):
        token = rng.choice(("", *crisis.FUSED, "مان", "زز")) + rng.choice(words) + rng.choice(("", "", "ش", "ا", "شا", "اش", "شش", "اا", "اشا", "اشش", "شاش", "ااا"))
        for g, pattern in groups.items():
            assert bool(pattern.search(token)) == plain.belongs(token, g), (token, g)


def sentences(rng, n):
    """Random rows of listed words, some of them in other shapes, with few neutral words between."""
    groups = [g for g in crisis.GROUPS if g != "RESEARCH_FRAME"]
    for k in range(n):
        rule = plain.RULES[k % len(plain.RULES)]
        names = [rule.trigger, *(s.group for s in rule.steps)]
        out = []
        for g in names if rng.random() < 0.8 else names[::-1]:
            out += [rng.choice(NEUTRAL) for _ in range(rng.choice((0, 0, 0, 1, 2, 3)))]
            if rng.random() < 0.15:
                out.append(rng.choice(("لا", "ما", "كتاب", "فضل", "تذكر", "عدو", "فلان", "والظالم", rng.choice(crisis.GROUPS[rng.choice(groups)]))))
            out.append(rng.choice(("", "", "", "و", "ال", "ما", "مان")) + rng.choice(crisis.GROUPS[g]) + rng.choice(("", "", "", "ش", "ا")))
        yield " ".join(out)
        if k % 3 == 0:
            marker = rng.choice(crisis._MARKERS)
            yield " ".join([*rng.sample(NEUTRAL, rng.randint(0, 2)), *rng.sample(("لا", "مش", "قال"), rng.randint(0, 1)), marker, *rng.sample(("عدو", "قال", "فلان", "للظالم"), rng.randint(0, 2))])
        if k % 3 == 1:
            yield " ".join(rng.choice(("ما", "نموتش", "مانحبش", "مابغيتش", "اعيش", "اموت", *NEUTRAL, *crisis.GROUPS["LIFE_BURDEN"], *crisis.GROUPS["REST_VERBS"], *crisis.GROUPS["DESIRE"][:6], "خلاص", "ابد")) for _ in range(rng.randint(1, 8)))


def test_columns_equal_reading_token_by_token(spark):
    rows = [s for s in sentences(random.Random(2), 1600)] + ["", " "]
    df = spark.createDataFrame([(s,) for s in rows], "q string").repartition(8)
    got = {r["q"]: (r["form"], r["risk"]) for r in df.select("q", crisis.search_form("q").alias("form"), crisis.detect_risk("q").alias("risk")).collect()}
    want = {q: plain.at_risk(form) for q, (form, _) in got.items()}
    assert [(q, want[q]) for q, (_, risk) in got.items() if risk != want[q]] == []
    assert 0.3 < sum(want.values()) / len(want) < 0.9


def test_no_python_worker(spark):
    df = spark.createDataFrame([("اريد ان اموت",), (None,)], "q string").withColumn("r", crisis.detect_risk("q"))
    assert "Python" not in df._jdf.queryExecution().toString() and [r["r"] for r in df.collect()] == [True, False]
    long = spark.createDataFrame([("كتاب " * 20_000,)], "q string").select(F.length("q"), crisis.detect_risk("q").alias("r"))
    assert long.first()["r"] is False
