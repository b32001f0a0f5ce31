"""Text functions as Column -> Column expressions, all inside the JVM.

Three normal forms are kept apart, because results depend on their differences: search_form (queries, scoring and gates), match_form
(grounding and quality rules) and dedupe_form (keys of the merge).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.lexicon import framing, words

# Character classes, maps and affixes that results depend on.
SPACE = "\\t-\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
MARKS = "\u064b-\u0652\u0670\u0640"
WIDE_MARKS = "\u064b-\u065f\u0670\u06d6-\u06ed\u0640"
STOPS = "\u060c\u061b\u061f\u066a\u066b\u066c\u066d\u06d4"
LETTERS_FROM, LETTERS_TO = "أإآٱؤئىة", "ااااوييه"
MATCH_FROM, MATCH_TO = "آأإىة", "ااايه"
ARTICLES = ("وال", "فال", "بال", "كال", "لل", "ال")
PREFIXES = ("وال", "فال", "بال", "كال", "لل", "ال", "و", "ف", "ب", "ك", "ل")
SUFFIXES = ("هما", "هم", "هن", "كما", "كم", "كن", "نا", "ها", "ه", "ي", "ك", "ين", "ون", "ان", "ات")
ARABIC = "[\u0600-\u06ff]"
CJK = "[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blank(x: Column, kept: str) -> Column:
    """Each run of characters other than these is one blank. A run that is one blank already is no match, since a replacement costs more than the search."""
    return F.regexp_replace(x, f" *[^ {kept}][^{kept}]*|  +", " ")


# Characters of the search form, one by one but for the Arabic block: a class of single characters is a table of bits, in which a character is looked up,
# while ranges are tested one after the other; and the marks that it drops.
_KEPT = "abcdefghijklmnopqrstuvwxyz0123456789\u0600-\u06ff"
_MARK_LIST = "".join(c for c in map(chr, range(0x600, 0x700)) if re.match(f"[{MARKS}]", c))


def search_form(c: Column | str) -> Column:
    """Without marks, letter variants unified, lower case; anything but Arabic-block characters, a-z and 0-9 is a space.

    Only texts with a character of the Arabic block have characters mapped one by one, which costs more than the rest.
    """
    x = F.lower(_col(c))
    mapped = F.translate(x, STOPS + LETTERS_FROM + _MARK_LIST, " " * len(STOPS) + LETTERS_TO)
    x = F.when((F.octet_length(x) > F.length(x)) & F.rlike(x, F.lit(ARABIC)), mapped).otherwise(x)
    return F.btrim(F.regexp_replace(x, f"[^{_KEPT}]+", " "))


def match_form(c: Column | str) -> Column:
    """Only Arabic-block characters, without marks; punctuation apart."""
    x = F.translate(F.regexp_replace(_col(c), f"[{WIDE_MARKS}]", ""), STOPS + MATCH_FROM, " " * len(STOPS) + MATCH_TO)
    return F.btrim(_blank(x, "\u0600-\u06ff"))


def dedupe_form(c: Column | str) -> Column:
    """As match_form, but punctuation of the Arabic block stays and the supplement is kept."""
    x = F.translate(F.regexp_replace(_col(c), f"[{WIDE_MARKS}]", ""), MATCH_FROM, MATCH_TO)
    return F.btrim(_blank(x, "\u0600-\u06ff\u0750-\u077f"))


def py_search_form(text: str) -> str:
    """search_form() of a constant, for word lists."""
    x = re.sub(f"[{MARKS}]", "", text)
    x = x.translate(str.maketrans(STOPS + LETTERS_FROM, " " * len(STOPS) + LETTERS_TO)).lower()
    return re.sub("[^\u0600-\u06ffa-z0-9]+", " ", x).strip()


def _first_prefix(prefixes: tuple[str, ...]) -> str:
    return f"^(?:{'|'.join(prefixes)})(?=.{{3,}}$)"


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once a row, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip_article(token: Column) -> Column:
    """The first fitting article prefix goes, if at least three characters stay. Only tokens that begin as an article does cost a search."""
    begins = F.left(token, F.lit(1)).isin(*sorted({a[0] for a in ARTICLES}))
    return F.when(begins, F.regexp_replace(token, _first_prefix(ARTICLES), "")).otherwise(token)


def _of_words(found: Column) -> Column:
    fine = lambda t: (F.length(t) >= 2) & ~t.isin(*words.STOPWORDS)
    return F.filter(F.transform(F.filter(found, fine), strip_article), fine)


def tokens(c: Column | str) -> Column:
    """Search tokens in order, repeats kept: two characters at least, no stop word before or after the article goes."""
    return _of_words(F.split(search_form(c), " "))


def token_set(c: Column | str, of=None) -> Column:
    """The distinct tokens() in order of first occurrence, of all words or those that pass; a repeated word is looked at once."""
    found = F.split(search_form(c), " ")
    return F.array_distinct(_of_words(F.array_distinct(F.filter(found, of) if of else found)))


def stemmed(token: Column) -> Column:
    """Whether a token's stem may be another word: all affixes are Arabic."""
    return F.octet_length(token) > F.length(token)


def canonical(token: Column) -> Column:
    """Light stem of a token in search form: one prefix, one suffix, then one of three verb letters, three characters kept.

    No suffix ends another, so one alternation finds the only one that fits.
    """
    x = F.regexp_replace(token, _first_prefix(PREFIXES), "")
    x = F.regexp_replace(F.regexp_replace(x, f"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$", "$1"), "^[يتن](?=.{3,}$)", "")
    return F.when(stemmed(token), x).otherwise(token)


def variants(token: Column) -> Column:
    """Distinct non-empty forms of a token: itself and its stem."""
    return F.filter(F.array_distinct(F.array(token, canonical(token))), lambda t: t != "")


def variant_set(c: Column | str) -> Column:
    """Distinct variants of all tokens of a text."""
    return F.array_distinct(F.flatten(F.transform(tokens(c), variants)))


def forms(token: Column) -> Column:
    """Variants of three characters or more, for synonyms."""
    return F.filter(variants(token), lambda t: F.length(t) >= 3)


def includes(haystack: Column | str, needle: Column | str) -> Column:
    """Containment in search form; an empty needle is in nothing."""
    n = search_form(needle)
    return (n != "") & F.contains(search_form(haystack), n)


def rewrite_dialect(c: Column | str) -> Column:
    """Whole-word rewrites on raw text in the order of the list; later ones see what earlier ones wrote."""

    def step(x: Column, pair: tuple[str, str]) -> Column:
        return F.regexp_replace(x, f"(^|[^\u0600-\u06ff]){re.escape(pair[0])}(?=$|[^\u0600-\u06ff])", "$1" + pair[1])

    return reduce(step, [p for p in words.DIALECT if p[0] != p[1]], _col(c))


def _letter_words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: F.rlike(t, F.lit("^[\u0621-\u064a]+$")))


def grounded(excerpt: Column | str, evidence: Column | str, form=search_form) -> Column:
    """Two words or more of the excerpt occur, in order and adjacent, among the evidence's pure letter words."""
    e, h = _letter_words(form(F.coalesce(_col(excerpt), F.lit("")))), _letter_words(form(F.coalesce(_col(evidence), F.lit(""))))
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return let(e, lambda v: (F.size(v) >= 2) & F.contains(pad(h), pad(v)))


# Fixed value: how a commentator's line begins.
COMMENTARY_LINE = (
    r"(?iu)^\s*(?:\[[^\]\n]{0,16}\]\s*)?[(（]?\s*(?:مطابقته للترجمة|مُطَابَقَتُهُ لِلتَّرْجَمَةِ|ذكر معناه|ذِكر معناه|ذكر رجاله|ذِكر رجاله|ذكر لطائف إسناده|ذِكر لطائف إسناده|"
    r"ذكر تعدد موضعه|ما يستفاد منه|ذكر ما يستفاد منه|قوله|قَوْلُهُ|قلت|قُلت|هذا الحديث|بيان الإعراب|بَيَانُ(?:ت)?\s*(?:الإعراب|اللغة))\s*(?:[:：)）.،]|\s|$)"
)


def carries_commentary(c: Column | str) -> Column:
    """Some line after the first begins as a commentator's; false for a blank or null text."""
    lines = F.split(F.coalesce(_col(c), F.lit("")), "\n")
    return F.exists(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda v: F.rlike(v, F.lit(COMMENTARY_LINE)))


def displayable(c: Column | str) -> Column:
    return (F.btrim(F.coalesce(_col(c), F.lit(""))) != "") & ~carries_commentary(c)


def arabic_punctuation(c: Column | str) -> Column:
    return F.translate(_col(c), ",;?", "،؛؟")


def first_sentences(c: Column | str, most: int = 2) -> Column:
    """The first sentences, without outer punctuation, each ended by an Arabic semicolon; empty without any."""
    flat = F.regexp_replace(arabic_punctuation(c), f"[{SPACE}]+", " ")
    parts = F.transform(F.split(flat, "[؛.؟!۔]+"), lambda s: F.regexp_replace(s, f"^[{SPACE}،؛؟.!:\\-]+|[{SPACE}،؛؟.!:\\-]+$", ""))
    kept = F.slice(F.filter(parts, lambda s: s != ""), 1, max(most, 0))
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "؛ "), F.lit("؛"))).otherwise("")


# What strict output may hold.
_ALLOWED = "^[\\s\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff0-9،؛؟.!:\\-–—()\\[\\]{}«»\"'•*/…۝۞۩٭﴿﴾]+$"
_LETTER = "[\u0621-\u063a\u0641-\u064a]"


def strict_output(c: Column | str) -> Column:
    """The cleaned text, or null: empty, over 5000 characters, Latin, CJK, anything not allowed, no letter, a URL or markup."""
    x = F.regexp_replace(_col(c), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "[ \t]+", " "), f"^[{SPACE}]+|[{SPACE}]+$", "")
    fine = (x != "") & (F.length(x) <= 5000) & ~F.rlike(x, F.lit("[A-Za-z]")) & ~F.rlike(x, F.lit(CJK)) & F.rlike(x, F.lit(_ALLOWED)) & F.rlike(x, F.lit(_LETTER))
    return F.when(fine & ~F.rlike(x, F.lit("(?i)https?://|www\\.|<[^>]+>|```|javascript:")), x)


def safe_scripture(c: Column | str) -> Column:
    x = F.btrim(_col(c))
    return (x != "") & (F.length(x) <= 20000) & ~F.rlike(x, F.lit(CJK)) & ~F.rlike(x, F.lit("[A-Za-z]")) & F.rlike(x, F.lit("[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff]"))


def pause_marks(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit("[\u06d6-\u06de]"))


def forbidden_framing(c: Column | str) -> Column:
    """The forbidden phrases and discouraged terms that the text holds, in the lists' order."""
    x = _col(c)
    return F.filter(F.array(*map(F.lit, framing.FORBIDDEN_PHRASES + framing.DISCOURAGED_TERMS)), lambda p: F.contains(x, p))


def overlap_ratio(needle: Column | str, haystack: Column | str, form=dedupe_form) -> Column:
    """Share of the needle's tokens of three characters or more, repeats counted, in the haystack; 1 without any."""
    n = F.filter(F.split(form(needle), " "), lambda t: F.length(t) >= 3)
    h = F.array_distinct(F.split(form(haystack), " "))
    found = lambda v: F.size(F.filter(v["n"], lambda t: F.array_contains(v["h"], t))) / F.nullif(F.size(v["n"]), F.lit(0))
    return let(F.struct(n.alias("n"), h.alias("h")), lambda v: F.when(F.size(v["n"]) == 0, 1.0).otherwise(found(v)))


def trim_excerpt(full: Column, excerpt: Column) -> Column:
    """full from where the excerpt begins, if that is within its first 45 characters but not at its start."""
    at = F.instr(full, excerpt)
    return F.when((at > 1) & (at <= 46), F.substr(full, at)).otherwise(full)
