"""Rule gates before retrieval, as columns; the first that fires decides the outcome."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import PREFIXES, SPACE, _col, let, py_search_form, rewrite_dialect, search_form
from corvid.lexicon import gates as L

from .crisis import detect_risk


def any_marker(form: Column, markers) -> Column:
    """Some marker, in search form, is in the text: one alternation, so that the expression stays small."""
    found = sorted({m for m in map(py_search_form, markers) if m})
    return F.rlike(form, F.lit("|".join(map(re.escape, found)))) if found else F.lit(False)


def _cores(form: Column) -> Column:
    return F.transform(F.filter(F.split(form, " "), lambda t: t != ""), lambda t: F.regexp_replace(t, f"^(?:{'|'.join(PREFIXES)})(?=.{{3,}}$)", ""))


def near(form: Column, cues, targets, span: int) -> Column:
    """A target within span tokens after a cue, both compared without one prefix."""
    wanted = F.array(*map(F.lit, targets))

    def at(tokens: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda k: F.coalesce(F.get(tokens, k - 1).isin(*cues), F.lit(False)) & F.arrays_overlap(F.slice(tokens, k + 1, span), wanted))

    return let(_cores(form), at)


def diagnosis(query: Column | str) -> Column:
    return any_marker(search_form(query), L.DIAGNOSIS)


def health_hint(query: Column | str) -> Column:
    return any_marker(search_form(query), L.HEALTH)


def prescription(query: Column | str) -> Column:
    form = search_form(query)
    strict = [m for m in L.MEDICATION_CUES if m != "دواء"]
    return any_marker(form, L.PRESCRIPTION) | near(form, L.QUANTITY_CUES, L.MEDICATION_CUES, 4) | near(form, L.INTAKE_CUES, [*strict, *L.CONDITION_CUES], 5)


def ruling(query: Column | str) -> Column:
    """A marker, a question that ends in a ruling's predicate, a noun phrase that asks for one, or a personal case."""
    form = search_form(query)
    words = F.split(form, " ")
    defines = F.arrays_overlap(words, F.array(*(F.lit(py_search_form(c)) for c in L.DEFINITION_CUES)))
    last = F.regexp_replace(F.element_at(words, -1), "^ال", "")
    predicates = [py_search_form(p) for p in L.RULING_PREDICATES]
    question = F.rlike(form, F.lit(f"^(?:{'|'.join(L.RULING_STARTERS)})(?: |$)")) & last.isin(*(p + end for p in predicates for end in ("", "ه", "ا")))
    noun = F.rlike(form, F.lit("^[وف]?(?:ال)?(?:حكم|احكام)(?:هما|هم|ها|ه)? \\S"))
    return any_marker(form, L.RULING) | (~defines & (question | noun)) | any_marker(form, L.PERSONAL_CASE)


def ruling_matter(query: Column | str) -> Column:
    """Label of the first matter of the list that the query names; null without one."""
    form = search_form(query)
    return F.coalesce(*(F.when(F.contains(form, F.lit(py_search_form(word))), F.lit(label)) for word, label in L.MATTERS))


def full_page_request(query: Column | str) -> Column:
    return F.rlike(_col(query), F.lit("(?s)(?:اذكر|اعطني|أعطني|اكتب|اعرض|انسخ|أنسخ).*(?:الصفحة|صفحة)\\s*[0-9٠-٩]+.*(?:بنصها|بنصه|كاملاً|كاملة|بالكامل|نصها)"))


def outcome(queries: DataFrame, query_col: str = "query", most: int = 1000) -> DataFrame:
    """queries with query (trimmed and cut), rewritten (dialect), gate, and outcome: null where retrieval decides.

    In order: invalid (under three characters), safety, diagnosis, ruling, prescription, full-page. A null query is invalid.
    """
    q = F.left(F.regexp_replace(F.coalesce(F.col(query_col), F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", ""), F.lit(most))
    x = queries.withColumn("query", q).withColumn("rewritten", rewrite_dialect("query"))
    gate = F.when(F.length("query") < 3, "invalid").when(detect_risk("rewritten"), "safety").when(diagnosis("rewritten"), "diagnosis")
    gate = gate.when(ruling("rewritten"), "ruling").when(prescription("rewritten"), "prescription").when(full_page_request("rewritten"), "full-page")
    x = x.withColumn("gate", gate)
    kind = F.when(F.col("gate").isin("invalid", "safety"), F.col("gate")).when(F.col("gate") == "ruling", "fatwa").when(F.col("gate").isNotNull(), "abstained")
    return x.withColumn("outcome", kind).withColumn("matter", F.when(F.col("gate") == "ruling", ruling_matter("rewritten")))
