"""Compositional reading of a query for personal intent to leave life: a positional index of token groups, and rules as a table over it.

A token's place in a row's index holds two bit sets: the groups that its core is in, and those that one of its shapes is in. A rule starts at a
core of its trigger group and walks steps: each looks for a group in a window after (or before) the place that the step before it found. Guards
keep research questions and other people's matters out. Lists are compared in search form. All of it is column expressions on one row, so that
queries are neither dealt out nor leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions.text import PREFIXES, _col, let, py_search_form, search_form
from corvid.lexicon import safety as L

GROUPS = {name: tuple(dict.fromkeys(getattr(L, name))) for name in dir(L) if name.isupper() and name not in ("MARKERS", "PATTERNS")}
# Small groups that only single rules use, and prefixes that dialects fuse with a word.
GROUPS |= {"BACK_REFERENCE": ("منها", "منه", "منهاش"), "SOLUTION": ("الحل", "حل", "الوحيد", "المخرج"), "ABILITY": ("اقدر", "اكدر", "قادر", "قادره", "فيني", "طاقه", "استمر", "اكمل")}
FUSED = (*PREFIXES, "ما", "مان")
#: Negation and desire in one word, as Maghrebi dialects write it, counts as a group of its own.
FUSED_DESIRE = "FUSED_DESIRE"
BIT = {name: 1 << k for k, name in enumerate([*sorted(GROUPS), FUSED_DESIRE])}
_MARKERS = tuple(m for m in dict.fromkeys(map(py_search_form, L.MARKERS)) if m)


def _any(words) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


def shape_pattern(words) -> str:
    """What a token of a group looks like: a word, or one of three letters or more with a fused prefix or final sheen and alif.

    A final sheen goes from tokens of five letters or more, an alif from four; behind a prefix one of them goes, without one up to
    three as far as these lengths allow.
    """
    three, four = [w for w in words if len(w) >= 3], [w for w in words if len(w) >= 4]
    ways = [_any(words)]
    if three:
        ways += [f"{_any(three)}(?:ا|اش|اا|اشا|اشش)", f"{_any(FUSED)}{_any(three)}(?:ش|ا)?"]
    if four:
        ways.append(f"{_any(four)}(?:ش|شا|شش)")
    return "^(?:" + "|".join(ways) + ")$"


class Step(NamedTuple):
    group: str
    span: int
    unframed: bool = False  # no research word between the place before and this one
    check: str = ""  # a condition of CHECKS on the place found


class Rule(NamedTuple):
    trigger: str
    steps: tuple[Step, ...]
    asserted: bool = False  # the trigger isn't negated
    alone: str = ""  # "anywhere": no research word in the query; "before": none in the three tokens before
    behind: int = 0  # the first step looks in a window that starts so many tokens before the trigger


RULES = (
    Rule("DESIRE", (Step("DEATH", 4, True, "not for others"),), asserted=True),
    Rule("DESIRE", (Step("DEPARTURE", 4, True), Step("LIFE_BURDEN", 3)), asserted=True),
    Rule("DESIRE", (Step("DEPARTURE", 4, True), Step("BACK_REFERENCE", 3, False, "burden before")), asserted=True),
    Rule("DESIRE", (Step("END_VERBS", 4), Step("LIFE_SELF", 3)), asserted=True),
    Rule("NEGATION_OR_INABILITY", (Step("DESIRE", 3), Step("LIVE", 3, True))),
    Rule("NEGATION_OR_INABILITY", (Step("LIVE", 3, False, "ability"), Step("LIVE", 3))),
    Rule("NEGATION_OR_INABILITY", (Step("LIVE", 3, False, "unframed rest"), Step("LIFE_BURDEN", 4))),
    Rule("NEGATION_OR_INABILITY", (Step("MEANING", 4), Step("PERSONAL_LIVE", 4))),
    Rule("NEGATION_OR_INABILITY", (Step("MEANING", 4), Step("LIFE_SELF", 4))),
    Rule("REST_VERBS", (Step("LIFE_BURDEN", 3, True),), asserted=True),
    Rule("REST_VERBS", (Step("FOREVER", 3, True),), asserted=True),
    Rule("SELF_BURDEN", (Step("DEPARTURE", 5),)),
    Rule("SELF_BURDEN", (Step("PERSON", 4),)),
    Rule("SELF_BURDEN", (Step("PERSON", 4),), behind=4),
    Rule("METHOD", (Step("SELF_OBJECT", 3),), alone="before"),
    Rule("METHOD_SEEK", (Step("DEATH", 4),), alone="anywhere"),
    Rule("OVERDOSE", (Step("REST_VERBS", 4),), alone="anywhere"),
    Rule("OVERDOSE", (Step("REST_VERBS", 4),), alone="anywhere", behind=4),
    Rule("OVERDOSE", (Step("DEATH", 4),), alone="anywhere"),
    Rule("OVERDOSE", (Step("FOREVER", 4),), alone="anywhere"),
    Rule("PREPARATION_VERBS", (Step("DEATH", 5),), alone="anywhere"),
    Rule("LIFE_SELF", (Step("HOPELESS", 4),)),
    Rule("EXHAUSTION", (Step("LIFE_BURDEN", 4),)),
    Rule("EXHAUSTION", (Step("LIFE_SELF", 4),)),
    Rule("DEATH", (Step("SOLUTION", 3, False, "asserted"),)),
    Rule("DECISION", (Step("END_VERBS", 4),)),
    Rule("DECISION", (Step("DEATH", 4),)),
    Rule(FUSED_DESIRE, (Step("LIVE", 3),)),
    Rule(FUSED_DESIRE, (Step("DEATH", 3),)),
)


def core(token: Column) -> Column:
    """The token without the first fitting prefix, if three characters stay."""
    return F.regexp_replace(token, f"^(?:{'|'.join(PREFIXES)})(?=.{{3,}}$)", "")


def _fused_desire(token: Column) -> Column:
    inner = F.substring(token, F.lit(3), F.length(token) - 3)
    desire = lambda c: c.isin(*GROUPS["DESIRE"])
    ways = desire(inner) | desire(F.substring(inner, F.lit(2), F.length(inner)))
    for p in ("ن", "ي", "ت", "ا"):
        ways = ways | desire(F.concat(F.lit(p), inner))
    return F.startswith(token, F.lit("ما")) & F.endswith(token, F.lit("ش")) & (F.length(inner) >= 2) & ways


_SHAPED = sorted({s.group for r in RULES for s in r.steps} | {"OTHER_TARGET", "LIFE_BURDEN", "DESIRE", "FOREVER", "DEPARTURE"})
_CORED = sorted({r.trigger for r in RULES if r.trigger != FUSED_DESIRE} | {"RESEARCH_FRAME", "NEGATION", "ABILITY", "REST_VERBS"})


def index(form: Column) -> Column:
    """A place for each token: cores, the groups that its core is in, and shapes, those that one of its shapes is in, as bits."""

    def bits(tests) -> Column:
        out = F.lit(0).cast("long")
        for name, test in tests:
            out = out.bitwiseOR(F.when(test, F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    def place(token: Column) -> Column:
        cores = let(core(token), lambda c: bits((g, c.isin(*GROUPS[g])) for g in _CORED)).bitwiseOR(bits([(FUSED_DESIRE, _fused_desire(token))]))
        some = F.rlike(token, F.lit(shape_pattern(dict.fromkeys(w for g in _SHAPED for w in GROUPS[g]))))  # most tokens are in no group
        shapes = F.when(some, bits((g, F.rlike(token, F.lit(shape_pattern(GROUPS[g])))) for g in _SHAPED)).otherwise(F.lit(0).cast("long"))
        return F.struct(cores.alias("cores"), shapes.alias("shapes"))

    return F.transform(F.filter(F.split(form, " "), lambda t: t != ""), place)


def _has(bits: Column, group: str) -> Column:
    return F.coalesce(bits.bitwiseAND(F.lit(BIT[group]).cast("long")) != 0, F.lit(False))


def _find(x: Column, start: Column, span: int, group: str) -> Column:
    """First place of the group in a window whose start never lies before the query; null without one."""
    return let(F.greatest(start, F.lit(0)), lambda s: F.array_min(F.filter(F.sequence(s, s + (span - 1)), lambda k: _has(F.get(x, k)["shapes"], group))))


def _cored(x: Column, start: Column, end: Column, group: str) -> Column:
    """Some core in [start, end) is in the group."""
    return let(F.greatest(start, F.lit(0)), lambda s: F.exists(F.slice(x, s + 1, F.greatest(end - s, F.lit(0))), lambda p: _has(p["cores"], group)))


def _negated(x: Column, at: Column) -> Column:
    return _cored(x, at - 2, at, "NEGATION")


def _burden_before(x: Column, at: Column) -> Column:
    """A burden lies before the departure that a back reference at `at` follows within three tokens."""
    return let(_find(x, at - 3, 3, "DEPARTURE"), lambda d: F.exists(F.slice(x, 1, d), lambda p: _has(p["shapes"], "LIFE_BURDEN")))


CHECKS: dict[str, Callable[[Column, Column], Column]] = {
    "not for others": lambda x, k: _find(x, k + 1, 3, "OTHER_TARGET").isNull(),
    "burden before": _burden_before,
    "ability": lambda x, k: _has(F.get(x, k)["cores"], "ABILITY"),
    "unframed rest": lambda x, k: ~_cored(x, k + 1, F.size(x), "RESEARCH_FRAME"),
    "asserted": lambda x, k: ~_negated(x, k),
}


def _walk(x: Column, steps: tuple[Step, ...], start: Column) -> Column:
    s, *rest = steps

    def found(k: Column) -> Column:
        out = k.isNotNull()
        if s.unframed:
            out = out & ~_cored(x, start, k, "RESEARCH_FRAME")
        if s.check:
            out = out & CHECKS[s.check](x, k)
        return out & _walk(x, tuple(rest), k + 1) if rest else out

    return let(_find(x, start, s.span, s.group), found)


def _fires(rule: Rule, x: Column, at: Column, research: Column) -> Column:
    out = F.lit(True)
    if rule.asserted:
        out = out & ~_negated(x, at)
    if rule.alone == "anywhere":
        out = out & ~research
    if rule.alone == "before":
        out = out & ~_cored(x, at - 3, at, "RESEARCH_FRAME")
    return out & _walk(x, rule.steps, at - rule.behind if rule.behind else at + 1)


def _rest_after_burden(x: Column, at: Column) -> Column:
    """A burden just before asserted rest, with desire between or for ever after."""

    def after(k: Column) -> Column:
        return (k < at) & (_find(x, k + 1, 4, "DESIRE").isNotNull() | _find(x, at + 1, 3, "FOREVER").isNotNull())

    return ~_negated(x, at) & F.coalesce(let(_find(x, at - 3, 3, "LIFE_BURDEN"), after), F.lit(False))


def composed(form: Column) -> Column:
    """Some rule fires at some token."""
    triggers = sorted({r.trigger for r in RULES})
    started = F.lit(sum(BIT[g] for g in {*triggers, "REST_VERBS"})).cast("long")

    def read(x: Column) -> Column:
        def at_place(at: Column, research: Column) -> Column:
            cores = F.get(x, at)["cores"]
            out = _has(cores, "REST_VERBS") & _rest_after_burden(x, at)
            for g in triggers:
                some = F.lit(False)
                for r in RULES:
                    if r.trigger == g:
                        some = some | F.coalesce(_fires(r, x, at, research), F.lit(False))
                out = out | (_has(cores, g) & some)
            return (cores.bitwiseAND(started) != 0) & out

        return let(_cored(x, F.lit(0), F.size(x), "RESEARCH_FRAME"), lambda research: F.exists(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0))), lambda at: F.coalesce(at_place(at, research), F.lit(False))))

    return let(index(form), read)


def affirmed_pattern(pattern: str) -> str:
    """pattern where no negation stands before it, and none of the two words after it is about someone else."""
    other = shape_pattern(GROUPS["OTHER_TARGET"])[1:-1]
    return f"(?<!(?:^| ){_any(GROUPS['NEGATION'])} ?)(?>{pattern})(?! ?{other}(?: |$)| ?[^ ]+ {other}(?: |$))"


def at_risk(form: Column) -> Column:
    """Marker list, patterns, then rules, on a text in search form; an empty text is at none."""
    marked = F.rlike(form, F.lit(_any(_MARKERS))) & F.rlike(form, F.lit("|".join(affirmed_pattern(re.escape(m)) for m in _MARKERS)))
    patterned = F.rlike(form, F.lit("|".join(map(affirmed_pattern, L.PATTERNS))))
    return marked | patterned | composed(form)


def detect_risk(query: Column | str) -> Column:
    """at_risk() of a raw text; a null one is empty. Texts without an Arabic letter or a Latin marker aren't read further: the other lists are Arabic."""
    latin = [m for m in _MARKERS if re.search("[a-z]", m)]
    maybe = "[ء-ي]" + (f"|{_any(latin)}" if latin else "")
    return let(search_form(F.coalesce(_col(query), F.lit(""))), lambda f: F.coalesce(F.when(F.rlike(f, F.lit(maybe)), at_risk(f)), F.lit(False)))


def dead_entries(texts: DataFrame, text: str) -> DataFrame:
    """(group, word): listed words that no token of the texts is, as it stands, without a prefix or in another shape: entries that never fire there.

    Distinct tokens meet the groups' patterns once each, whatever the number of texts.
    """
    seen = texts.select(F.explode(F.array_distinct(F.split(search_form(F.coalesce(_col(text), F.lit(""))), " "))).alias("token")).where("token <> ''").distinct()
    cut = lambda t, end: F.regexp_replace(t, f"{end}$", "")
    bare = [F.col("token"), *(F.substring("token", F.lit(len(p) + 1), F.length("token")) for p in FUSED)]
    forms = F.array_distinct(F.flatten(F.array(*(F.array(b, cut(b, "ش"), cut(b, "ا"), cut(cut(b, "ش"), "ا"), cut(cut(b, "ا"), "ش")) for b in bare))))
    spark = texts.sparkSession
    listed = spark.createDataFrame([(g, w) for g in sorted(GROUPS) for w in GROUPS[g]], "group string, word string")
    near = seen.select("token", F.explode(forms).alias("word")).join(F.broadcast(listed), "word")  # the fixed list
    patterns = F.create_map(*(F.lit(v) for g in sorted(GROUPS) for v in (g, shape_pattern(GROUPS[g]))))
    fired = near.where(F.rlike("token", F.get(F.array(F.element_at(patterns, F.col("group"))), F.lit(0))) & F.rlike("token", F.concat(F.lit("^(?:"), F.lit(_any(FUSED)), F.lit(")?"), "word", F.lit("(?:ش|ا|اش|شا|شش|اا|اشا|اشش)?$"))))
    return listed.join(fired.select("group", "word").distinct(), ["group", "word"], "left_anti")
