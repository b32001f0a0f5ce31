"""DuckDB expressions equal to the library's text functions, for the oracles."""

from __future__ import annotations

from corvid.functions import text as X
from corvid.lexicon import words


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def norm(x: str) -> str:
    a, b = X.STOPS + X.LETTERS_FROM, " " * len(X.STOPS) + X.LETTERS_TO
    return f"trim(regexp_replace(lower(translate(regexp_replace({x}, '[{X.MARKS}]', '', 'g'), {quoted(a)}, {quoted(b)})), '[^\u0600-\u06ffa-z0-9]+', ' ', 'g'))"


def _prefix(affixes) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(t, {quoted(a)}) AND length(t) >= {len(a) + 3} THEN substr(t, {len(a) + 1})" for a in affixes) + " ELSE t END"


def tokens(x: str) -> str:
    fine = f"length(t) >= 2 AND NOT list_contains({listed(words.STOPWORDS)}, t)"
    return f"list_filter(list_transform(list_filter(string_split({norm(x)}, ' '), lambda t: {fine}), lambda t: {_prefix(X.ARTICLES)}), lambda t: {fine})"


def stems(tokens_: str) -> str:
    suffix = "CASE " + " ".join(f"WHEN suffix(t, {quoted(a)}) AND length(t) >= {len(a) + 3} THEN substr(t, 1, length(t) - {len(a)})" for a in X.SUFFIXES) + " ELSE t END"
    verb = "CASE WHEN list_contains(['ي', 'ت', 'ن'], substr(t, 1, 1)) AND length(t) >= 4 THEN substr(t, 2) ELSE t END"
    return f"list_transform(list_transform(list_transform({tokens_}, lambda t: {_prefix(X.PREFIXES)}), lambda t: {suffix}), lambda t: {verb})"


def stem_of(token: str) -> str:
    """stems() of one token."""
    return f"({stems(f'[{token}]')})[1]"


def clean(x: str) -> str:
    """Tags, the entities that occur in the tables, blanks."""
    from corvid.lexicon.framing import ENTITIES

    for tag in ("script", "style", "noscript", "svg"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)<img[^>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)<br\\s*/?\\s*>|</(?:p|div|section|article|main|header|footer|li|h[1-6]|tr|td|th)>', chr(10), 'g')"
    x = f"translate(regexp_replace({x}, '<[^>]+>', ' ', 'g'), chr(160), ' ')"
    for _ in range(2):
        for name in ("copy", "middot", "quot", "lt", "gt", "nbsp", "amp"):
            x = f"replace({x}, '&{name};', {quoted(ENTITIES[name])})"
        x = f"regexp_replace({x}, '&amp([^a-zA-Z0-9;=]|$)', '&\\1', 'g')"
    x = f"regexp_replace(regexp_replace(regexp_replace({x}, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]*)\\]\\(\\s*(?:https?:)?//[^)]*\\)', '\\1', 'g'), 'https?://\\S+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[\u200b-\u200d\ufeff]', '', 'g'), '[ \\t\u00a0]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({x}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def crisis_rules(forms: str, row: str) -> str:
    """CTEs up to fired (row): rows of the relation forms (row, f) on which some composed rule fires, as joins over a table of tokens."""
    from corvid.operators import crisis as K

    has = lambda t, kind, g: f"{t}.{kind} & {K.BIT[g]} <> 0"
    near = lambda start, end, kind, g: f"EXISTS (SELECT 1 FROM tok x WHERE x.{row} = a.{row} AND x.pos >= greatest(0, {start}) AND x.pos < {end} AND {has('x', kind, g)})"
    first = lambda start, span, g: f"(SELECT min(x.pos) FROM tok x WHERE x.{row} = a.{row} AND x.pos >= greatest(0, {start}) AND x.pos < greatest(0, {start}) + {span} AND {has('x', 'shapes', g)})"
    checks = {
        "not for others": f"NOT {near('k + 1', 'k + 4', 'shapes', 'OTHER_TARGET')}", "ability": near("k", "k + 1", "cores", "ABILITY"),
        "unframed rest": f"NOT {near('k + 1', '1000000', 'cores', 'RESEARCH_FRAME')}", "asserted": f"NOT {near('k - 2', 'k', 'cores', 'NEGATION')}",
        "burden before": near("0", first("k - 3", 3, "DEPARTURE"), "shapes", "LIFE_BURDEN"),
    }
    bits = lambda names, test: " | ".join(f"CASE WHEN {test(g)} THEN {K.BIT[g]}::BIGINT ELSE 0 END" for g in names)
    inner = "substr(t, 3, length(t) - 3)"
    fused = f"starts_with(t, 'ما') AND suffix(t, 'ش') AND length(t) >= 5 AND list_has_any([{inner}, substr({inner}, 2), {', '.join(f'{quoted(p)} || {inner}' for p in 'نيتا')}], {listed(K.GROUPS['DESIRE'])})"
    parts = [
        f"""tok AS (SELECT {row}, pos, ({bits(K._CORED, lambda g: f"list_contains({listed(K.GROUPS[g])}, c)")} | CASE WHEN {fused} THEN {K.BIT[K.FUSED_DESIRE]}::BIGINT ELSE 0 END) AS cores, ({bits(K._SHAPED, lambda g: f"regexp_matches(t, {quoted(K.shape_pattern(K.GROUPS[g]))})")}) AS shapes
FROM (SELECT {row}, t, pos, {_prefix(X.PREFIXES)} AS c FROM (SELECT {row}, unnest(string_split(f, ' ')) AS t, unnest(range(len(string_split(f, ' ')))) AS pos FROM {forms}) WHERE t <> ''))""",
        f"research AS (SELECT DISTINCT {row} FROM tok WHERE {has('tok', 'cores', 'RESEARCH_FRAME')})",
    ]
    for n, r in enumerate(K.RULES):
        begin = [has("a", "cores", r.trigger)]
        if r.asserted:
            begin.append(f"NOT {near('a.pos - 2', 'a.pos', 'cores', 'NEGATION')}")
        if r.alone:
            begin.append(f"a.{row} NOT IN (SELECT {row} FROM research)" if r.alone == "anywhere" else f"NOT {near('a.pos - 3', 'a.pos', 'cores', 'RESEARCH_FRAME')}")
        parts.append(f"r{n}_0 AS (SELECT {row}, {f'pos - {r.behind}' if r.behind else 'pos + 1'} AS s FROM tok a WHERE {' AND '.join(begin)})")
        for m, step in enumerate(r.steps):
            fine = ["k IS NOT NULL", *([f"NOT {near('s', 'k', 'cores', 'RESEARCH_FRAME')}"] if step.unframed else []), *([checks[step.check]] if step.check else [])]
            parts.append(f"r{n}_{m + 1} AS (SELECT {row}, k + 1 AS s FROM (SELECT {row}, s, {first('s', step.span, step.group)} AS k FROM r{n}_{m} a) a WHERE {' AND '.join(fine)})")
    rest = f"SELECT {row} FROM (SELECT {row}, pos, {first('a.pos - 3', 3, 'LIFE_BURDEN')} AS k FROM tok a WHERE {has('a', 'cores', 'REST_VERBS')} AND NOT {near('a.pos - 2', 'a.pos', 'cores', 'NEGATION')}) a WHERE k < pos AND ({near('k + 1', 'k + 5', 'shapes', 'DESIRE')} OR {near('a.pos + 1', 'a.pos + 4', 'shapes', 'FOREVER')})"
    return ",\n".join([*parts, "fired AS (" + " UNION ".join([*(f"SELECT {row} FROM r{n}_{len(r.steps)}" for n, r in enumerate(K.RULES)), rest]) + ")"])
