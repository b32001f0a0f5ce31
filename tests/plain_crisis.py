"""The rules of corvid.operators.crisis read token by token, to hold its columns against.

A rule starts at a token of its trigger group and walks steps: each looks for a group in a window after (or before) the place that
the step before it found. Guards keep research questions and other people's matters out. Lists are compared in search form.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

from corvid.functions.text import PREFIXES, py_search_form
from corvid.lexicon import safety as L

GROUPS = {name: frozenset(getattr(L, name)) for name in dir(L) if name.isupper() and name not in ("MARKERS", "PATTERNS")}
# Small groups that only single rules use, and prefixes that dialects fuse with a word.
GROUPS |= {"BACK_REFERENCE": frozenset(("منها", "منه", "منهاش")), "SOLUTION": frozenset(("الحل", "حل", "الوحيد", "المخرج")), "ABILITY": frozenset(("اقدر", "اكدر", "قادر", "قادره", "فيني", "طاقه", "استمر", "اكمل"))}
FUSED = (*PREFIXES, "ما", "مان")
_MARKERS = tuple(m for m in dict.fromkeys(map(py_search_form, L.MARKERS)) if m)
_PATTERNS = tuple(map(re.compile, L.PATTERNS))


@lru_cache(maxsize=50_000)
def core(token: str) -> str:
    """The token without the first fitting prefix, if three characters stay."""
    return next((token[len(p) :] for p in PREFIXES if token.startswith(p) and len(token) - len(p) >= 3), token)


@lru_cache(maxsize=50_000)
def shapes(token: str) -> frozenset[str]:
    """The token and what it may be without a final sheen or alif and without a fused prefix; three characters at least."""
    cut = lambda t, end, least: [t[:-1]] if t.endswith(end) and len(t) >= least else []
    bases = [token, *cut(token, "ش", 5), *cut(token, "ا", 4)]
    out = set(bases)
    for b in bases:
        out.update(cut(b, "ا", 4))
        for c in cut(b, "ش", 5):
            out.update([c, *cut(c, "ا", 4)])
        out.update(b[len(p) :] for p in FUSED if b.startswith(p))
    return frozenset(t for t in out if len(t) >= 3) | {token}


def belongs(token: str, group: str) -> bool:
    return not GROUPS[group].isdisjoint(shapes(token)) or core(token) in GROUPS[group]


def find(tokens: list[str], start: int, span: int, group: str) -> int:
    """First place of the group in a window whose start never lies before the query; -1 without one."""
    start = max(0, start)
    return next((k for k in range(start, min(len(tokens), start + span)) if belongs(tokens[k], group)), -1)


def framed(tokens: list[str], start: int, end: int) -> bool:
    """A research word lies in the range."""
    return any(core(t) in GROUPS["RESEARCH_FRAME"] for t in tokens[max(0, start) : max(0, end)])


def negated(tokens: list[str], at: int) -> bool:
    return any(core(t) in GROUPS["NEGATION"] for t in tokens[max(0, at - 2) : at])


def fused_desire(token: str) -> bool:
    """Negation and desire in one word, as Maghrebi dialects write it."""
    inner = token[2:-1]
    if not (token.startswith("ما") and token.endswith("ش") and len(inner) >= 2):
        return False
    return any({p + inner, inner[len(p) :]} & GROUPS["DESIRE"] for p in ("", "ن", "ي", "ت", "ا"))


class Step(NamedTuple):
    group: str
    span: int
    unframed: bool = False  # no research word between the place before and this one
    check: Callable[[list[str], int], bool] | None = None  # of the tokens and the place found


class Rule(NamedTuple):
    trigger: str
    steps: tuple[Step, ...]
    asserted: bool = False  # the trigger isn't negated
    alone: str = ""  # "anywhere": no research word in the query; "before": none in the three tokens before
    behind: int = 0  # the first step looks in a window that starts so many tokens before the trigger


def _not_for_others(tokens, at):
    return find(tokens, at + 1, 3, "OTHER_TARGET") < 0


def _burden_before(tokens, at):
    return any(not GROUPS["LIFE_BURDEN"].isdisjoint(shapes(t)) for t in _upto(tokens, at))


def _upto(tokens, at):
    """The tokens before the departure that a back reference at `at` follows."""
    last = max(k for k in range(at) if belongs(tokens[k], "DEPARTURE"))
    first = next(k for k in range(max(0, at - 3), last + 1) if belongs(tokens[k], "DEPARTURE"))
    return tokens[:first]


RULES = (
    Rule("DESIRE", (Step("DEATH", 4, True, _not_for_others),), asserted=True),
    Rule("DESIRE", (Step("DEPARTURE", 4, True), Step("LIFE_BURDEN", 3)), asserted=True),
    Rule("DESIRE", (Step("DEPARTURE", 4, True), Step("BACK_REFERENCE", 3, False, _burden_before)), asserted=True),
    Rule("DESIRE", (Step("END_VERBS", 4), Step("LIFE_SELF", 3)), asserted=True),
    Rule("NEGATION_OR_INABILITY", (Step("DESIRE", 3), Step("LIVE", 3, True))),
    Rule("NEGATION_OR_INABILITY", (Step("LIVE", 3, False, lambda t, k: core(t[k]) in GROUPS["ABILITY"]), Step("LIVE", 3))),
    Rule("NEGATION_OR_INABILITY", (Step("LIVE", 3, False, lambda t, k: not framed(t, k + 1, len(t))), Step("LIFE_BURDEN", 4))),
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
    Rule("DEATH", (Step("SOLUTION", 3, False, lambda t, k: not negated(t, k)),)),
    Rule("DECISION", (Step("END_VERBS", 4),)),
    Rule("DECISION", (Step("DEATH", 4),)),
)


def _fires(rule: Rule, tokens: list[str], at: int, research: bool) -> bool:
    if (rule.asserted and negated(tokens, at)) or (rule.alone == "anywhere" and research) or (rule.alone == "before" and framed(tokens, at - 3, at)):
        return False
    start = at - rule.behind if rule.behind else at + 1
    for s in rule.steps:
        k = find(tokens, start, s.span, s.group)
        if k < 0 or (s.unframed and framed(tokens, start, k)) or (s.check and not s.check(tokens, k)):
            return False
        start = k + 1
    return True


def _rest_after_burden(tokens: list[str], at: int) -> bool:
    """A burden just before asserted rest, with desire between or for ever after."""
    k = find(tokens, at - 3, 3, "LIFE_BURDEN")
    return core(tokens[at]) in GROUPS["REST_VERBS"] and not negated(tokens, at) and 0 <= k < at and (find(tokens, k + 1, 4, "DESIRE") >= 0 or find(tokens, at + 1, 3, "FOREVER") >= 0)


def composed(form: str) -> bool:
    tokens = form.split()
    research = framed(tokens, 0, len(tokens))
    for at, token in enumerate(tokens):
        c = core(token)
        if any(c in GROUPS[r.trigger] and _fires(r, tokens, at, research) for r in RULES) or _rest_after_burden(tokens, at):
            return True
        if fused_desire(token) and (find(tokens, at + 1, 3, "LIVE") >= 0 or find(tokens, at + 1, 3, "DEATH") >= 0):
            return True
    return False


def _affirmed(form: str, start: int, end: int) -> bool:
    """Neither negated by the word before nor about someone else in the two words after."""
    before, after = form[:start].split(), form[end:].split()[:2]
    return not (before and before[-1] in GROUPS["NEGATION"]) and not any(not GROUPS["OTHER_TARGET"].isdisjoint(shapes(w)) for w in after)


def at_risk(form: str) -> bool:
    """Marker list, patterns, then rules, on a text in search form."""
    if not form:
        return False
    for m in _MARKERS:
        at = form.find(m)
        while at >= 0:
            if _affirmed(form, at, at + len(m)):
                return True
            at = form.find(m, at + len(m))
    return any(_affirmed(form, *m.span()) for p in _PATTERNS for m in p.finditer(form)) or composed(form)
