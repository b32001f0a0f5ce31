"""Matn and commentary of a landed page, as columns over the array of its lines: numbered candidates, the lines that belong to the best one, and where commentary begins.

A page is one row and stays one: its lines are islands between lines that break them, found by places in the array.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html as H
from .text import ARABIC, COMMENTARY_LINE, _col, dedupe_form, let, overlap_ratio

# Limits, and labels of the site's interface that end a commentary.
LEAST, ALIKE, WINDOW = 60, 0.6, 4000
TAIL_LABELS = ("تحليل الحديث", "الأعلام والأماكن", "مقارنة المتون", "إضافة تعليق", "الرواة")
NUMBERED = r"^(\d{1,5})\s*[-–—]\s*"
STARS = r"\*\s*\*\s*\*"
_MARK = "(?i)(?:" + "|".join(H.COMMENTARY_MARKS) + ")"


def _tidy(c: Column) -> Column:
    return H.clean(c, tags=False)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda v: F.btrim(v)), lambda v: v != "")


def _arabic(c: Column) -> Column:
    return F.rlike(c, F.lit(ARABIC))


def once(lines: Column) -> Column:
    """Lines in order without those that have no form, and without later copies of forms of LEAST characters or more."""
    keyed = F.transform(lines, lambda v: F.struct(v.alias("line"), dedupe_form(v).alias("key")))

    def kept(x: Column) -> Column:
        long = F.transform(x, lambda v: F.when(F.length(v["key"]) >= LEAST, v["key"]))
        fresh = F.filter(x, lambda v, k: (v["key"] != "") & ((F.length(v["key"]) < LEAST) | (F.array_position(long, v["key"]) == k + 1)))
        return F.transform(fresh, lambda v: v["line"])

    return let(keyed, kept)


def snippet(title: Column | str) -> Column:
    """A result title's words: no ordinal, no book name, no final punctuation."""
    from corvid.operators.ingest import result_title

    return result_title(title)["snippet"]


def extract(page_text: Column, hint: Column) -> Column:
    """struct<number, matn, commentary, matched> of readable text: the numbered line most like the hint and the lines that belong to it.

    The lines after it belong to it up to one that is noise, numbered, a separator or opens a commentary. Without a numbered line, a window from
    where the hint stands in the text. An empty hint takes the first numbered line.
    """

    def result(number: Column, block: Column, matched) -> Column:
        return let(H.split_commentary(block), lambda s: F.struct(number.alias("number"), s["matn"].alias("matn"), s["commentary"].alias("commentary"), matched(s["matn"]).alias("matched")))

    def numbered(v: dict) -> Column:
        lines, hint, best = v["lines"], v["hint"], v["best"]
        breaks = lambda w: H.is_noise(w) | F.rlike(w, F.lit(NUMBERED)) | (w == "* * *") | F.rlike(w, F.lit(COMMENTARY_LINE))
        after = F.slice(lines, best["at"] + 2, F.size(lines))
        stop = F.array_position(F.transform(after, breaks), True)
        belonging = F.filter(F.when(stop > 0, F.slice(after, F.lit(1), (stop - 1).cast("int"))).otherwise(after), _arabic)
        block = F.array_join(once(F.concat(F.array(best["body"]), belonging)), "\n")
        return result(best["number"], block, lambda matn: F.when(dedupe_form(hint) != "", overlap_ratio(hint, matn) >= ALIKE).otherwise(True))

    def window(v: dict) -> Column:
        at = F.when(dedupe_form(v["hint"]) != "", F.instr(v["text"], F.btrim(v["hint"]))).otherwise(0)
        part = F.substring(v["text"], F.greatest(at - 40, F.lit(1)), F.lit(WINDOW) + at - F.greatest(at - 40, F.lit(1)))
        kept = once(F.filter(F.split(_tidy(part), "\n"), lambda w: ~H.is_noise(w) & _arabic(w)))
        block = F.regexp_replace(_tidy(F.array_join(kept, "\n")), NUMBERED, "")
        none = F.struct(F.lit("").alias("number"), F.lit("").alias("matn"), F.lit("").alias("commentary"), F.lit(False).alias("matched"))
        return F.when(at > 0, result(F.lit(""), block, lambda _: F.lit(True))).otherwise(none)

    def read(x: Column) -> Column:
        v = {c: x[c] for c in ("text", "hint", "lines")}
        wanted = dedupe_form(v["hint"]) != ""
        body = lambda w: F.btrim(F.regexp_replace(w, NUMBERED, ""))
        entries = F.transform(v["lines"], lambda w, k: F.struct(k.alias("at"), F.regexp_extract(w, NUMBERED, 1).alias("number"), body(w).alias("body"), w.alias("line")))
        fine = F.filter(entries, lambda e: (e["number"] != "") & ~H.is_noise(e["line"]) & (F.length(e["body"]) >= 40) & _arabic(e["body"]))
        scored = F.transform(fine, lambda e: F.struct(F.when(wanted, -overlap_ratio(v["hint"], e["body"])).otherwise(0.0).alias("unlike"), e["at"].alias("at"), e["number"].alias("number"), e["body"].alias("body")))

        def choose(c: Column) -> Column:
            best = F.array_min(F.filter(c, lambda e: e["unlike"] <= -ALIKE))
            return F.coalesce(best, F.get(c, F.lit(0)))

        return let(let(scored, choose), lambda best: F.when(best.isNotNull(), numbered(v | {"best": best})).otherwise(window(v)))

    text = _tidy(page_text)
    return let(let(F.struct(text.alias("text"), hint.alias("hint")), lambda t: F.struct(t["text"].alias("text"), t["hint"].alias("hint"), _lines(t["text"]).alias("lines"))), read)


def explanation(page_text: Column, most: int = 6000) -> Column:
    """The commentary in the readable text of a service page: after the separator, from its first mark, without the interface's tail; empty if it is too short."""
    text = F.regexp_replace(page_text, f"(?s)^.*?{STARS}", "")
    body = _tidy(F.regexp_extract(text, f"(?s)({_MARK}.*)$", 1))

    def without(label: str, body: Column) -> Column:
        return let(body, lambda b: let(F.regexp_extract(b, f"(?s)^(.*){re.escape(label)}", 1), lambda head: F.when(F.length(head) > 400, head).otherwise(b)))

    for label in TAIL_LABELS:
        body = without(label, body)
    return let(body, lambda b: let(F.regexp_replace(b, r"^\s+|\s+$", ""), lambda v: F.when(F.length(dedupe_form(v)) >= LEAST, H.truncate_at_boundary(v, most)).otherwise("")))


def references(page: Column, wanted: Column, parameter: str) -> Column:
    quoted = F.concat(F.lit(f"(?i){parameter}=\\Q"), F.replace(wanted, F.lit("\\E"), F.lit("")), F.lit("\\E(?![0-9])"))
    return F.regexp_count(page, quoted)


def detail_page(page: Column | str, url: Column | str, title: Column | str, parameter: str = "mainId", most: int = 6000) -> Column:
    """struct<reason, number, matn, explanation>: why a detail page isn't usable, the first of the checks in their order (null if it is), and what it says.

    A null page is empty; a null url names no page, a null title no excerpt.
    """
    p, hint = F.coalesce(_col(page), F.lit("")), snippet(F.coalesce(_col(title), F.lit("")))
    wanted = H.query_parameter(F.coalesce(_col(url), F.lit("")), parameter)

    def early(v: Column) -> Column:
        out = F.when(F.regexp_replace(v["page"], r"(?U)\s+", "") == "", "empty-response").when(F.rlike(v["page"], F.lit(H.BLOCKED)), "block-page")
        out = out.when(~_arabic(v["text"]), "no-arabic-content").when(F.rlike(v["text"], F.lit(H.SOFT_ERROR)) & (F.length(v["text"]) < 900), "site-error-page")
        return out.when((v["wanted"] != "") & (references(v["page"], v["wanted"], parameter) < 2), F.concat(F.lit(f"page-does-not-reference-{parameter}-"), v["wanted"]))

    def read(v: Column) -> Column:
        def said(found: Column) -> Column:
            marked = F.rlike(v["text"], F.lit(STARS)) | F.rlike(v["text"], F.lit(_MARK))
            own = F.when(marked, explanation(v["text"], most)).otherwise("")
            rest = F.when(F.length(dedupe_form(found["commentary"])) >= LEAST, H.truncate_at_boundary(found["commentary"], most)).otherwise("")
            late = F.when(found["matn"] == "", "no-matn-extracted").when(F.length(found["matn"]) < LEAST, "matn-too-short").when((v["hint"] != "") & ~found["matched"], "matn-does-not-match-result-excerpt")
            return F.struct(late.alias("reason"), found["number"].alias("number"), found["matn"].alias("matn"), F.coalesce(F.nullif(own, F.lit("")), rest).alias("explanation"))

        nothing = lambda why: F.struct(why.alias("reason"), *(F.lit("").alias(c) for c in ("number", "matn", "explanation")))
        return let(early(v), lambda why: F.when(why.isNotNull(), nothing(why)).otherwise(let(extract(v["whole"], v["hint"]), said)))

    def cleaned(v: Column) -> Column:
        # markup that entities stood for goes from what is extracted; a clean text without any stays as it is
        whole = F.when(F.rlike(v["text"], F.lit(r"[<&\[]|http")), H.clean(v["text"])).otherwise(v["text"])
        return let(F.struct(v["page"].alias("page"), v["text"].alias("text"), whole.alias("whole"), v["wanted"].alias("wanted"), v["hint"].alias("hint")), read)

    return let(let(p, lambda p: F.struct(p.alias("page"), H.clean(H.main_html(p)).alias("text"), wanted.alias("wanted"), hint.alias("hint"))), cleaned)


def commentary_page(page: Column | str, url: Column | str, parameter: str = "mainId", most: int = 6000) -> Column:
    """struct<reason, explanation> of a commentary page; nulls are as for detail_page()."""
    p = F.coalesce(_col(page), F.lit(""))
    wanted = H.query_parameter(F.coalesce(_col(url), F.lit("")), parameter)

    def read(v: Column) -> Column:
        def judged(said: Column) -> Column:
            reason = F.when((F.length(v["text"]) < 200) | ~_arabic(v["text"]) | F.rlike(v["page"], F.lit(H.BLOCKED)), "not-a-commentary-page").when(~F.rlike(v["text"], F.lit(_MARK)), "no-commentary-markers")
            reason = reason.when(said == "", "no-explanation-extracted").when((v["wanted"] != "") & (references(v["page"], v["wanted"], parameter) < 1), "commentary-does-not-reference-itself")
            return F.struct(reason.alias("reason"), F.when(reason.isNull(), said).otherwise("").alias("explanation"))

        return let(explanation(v["text"], most), judged)

    return let(F.struct(p.alias("page"), H.clean(H.main_html(p)).alias("text"), wanted.alias("wanted")), read)
