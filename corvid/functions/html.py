"""HTML and URL functions as columns; only URL resolution leaves the JVM, in Arrow batches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.lexicon import framing

from .text import _col, let

HIDDEN = "(?is)<(script|style|noscript|svg)\\b.*?</\\1>|<img[^>]*>"
# The elements of HIDDEN in the order in which they go, each kind from the whole page, since one may begin inside another.
HIDDEN_ELEMENTS = ("script", "style", "noscript", "svg")


@dataclass(frozen=True)
class Rules:
    """How markup is read: by default as given; entities: only these names, as they are written, in this order and two rounds.

    space: what a class of white space holds. fold: letter case is Unicode's, in which the long s is an s and the Kelvin sign a k.
    """

    entities: tuple[str, ...] = ()
    space: str = "\\s"
    fold: bool = False

    def letters(self, pattern: str) -> str:
        return pattern.replace("s", "[s\u017f]").replace("k", "[k\u212a]") if self.fold else pattern


GIVEN = Rules()
_NUMBER = re.compile(r"&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));?")
_NAME = re.compile(r"&([a-zA-Z][a-zA-Z0-9]{1,31});")
_OPEN = re.compile(r"&(amp|lt|gt|quot|apos|nbsp)(?![a-zA-Z0-9;=])", re.I)


def _entity(m: re.Match) -> str:
    n = int(m[1]) if m[1] else int(m[2], 16)
    return m[0] if n > 0x10FFFF else "\ufffd" if 0xD800 <= n <= 0xDFFF else chr(n)


def py_decode(value: str) -> str:
    """Numbers, known names and unterminated legacy names, until nothing changes, four times at most."""
    for _ in range(4):
        new = _NUMBER.sub(_entity, value)
        new = _NAME.sub(lambda m: framing.ENTITIES.get(m[1].lower(), m[0]), new)
        new = _OPEN.sub(lambda m: framing.ENTITIES[m[1].lower()], new)
        if new == value:
            break
        value = new
    return value


def decode_entities(c: Column | str) -> Column:
    """py_decode() as a column: texts without an ampersand are not looked at again, others are cut at their entities."""
    names = F.create_map(*(F.lit(v) for pair in sorted(framing.ENTITIES.items()) for v in pair))

    def number(v: Column) -> Column:
        digits = F.regexp_extract(v, "^&#([0-9]{1,7})", 1)
        n = F.when(digits != "", digits).otherwise(F.conv(F.regexp_extract(v, "^&#[xX]([0-9a-fA-F]{1,6})", 1), 16, 10)).cast("int")
        # U+FEFF would be read as a byte order mark
        char = lambda n: F.when(n > 0x10FFFF, v).when(n.between(0xD800, 0xDFFF), "\ufffd").when(n == 0xFEFF, "\ufeff").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        return let(n, char)

    def name(v: Column) -> Column:
        return F.coalesce(F.element_at(names, F.lower(F.regexp_replace(v, "[&;]", ""))), v)

    def each(x: Column, entity: str, decoded) -> Column:
        parts = F.regexp_extract_all(x, F.lit(f"{entity}|[^&]+|&"), F.lit(0))
        return F.array_join(F.transform(parts, lambda v: F.when(F.rlike(v, F.lit(f"^(?:{entity})")), decoded(v)).otherwise(v)), "")

    def once(x: Column) -> Column:
        x = each(x, "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", number)
        x = each(x, "&[a-zA-Z][a-zA-Z0-9]{1,31};", name)
        return each(x, "&(?i:amp|lt|gt|quot|apos|nbsp)(?![a-zA-Z0-9;=])", name)

    rounds = F.array(*map(F.lit, range(4)))
    return F.aggregate(rounds, _col(c), lambda v, _: F.when(F.contains(v, F.lit("&")), once(v)).otherwise(v))


def decode_listed(c: Column | str, names: tuple[str, ...]) -> Column:
    """These names, one after the other, then an ampersand without its semicolon; two rounds."""

    def once(x: Column) -> Column:
        for name in names:
            x = F.replace(x, F.lit(f"&{name};"), F.lit(framing.ENTITIES[name]))
        return F.regexp_replace(x, "&amp([^a-zA-Z0-9;=]|\\z)", "&$1")

    return F.aggregate(F.array(F.lit(0), F.lit(1)), _col(c), lambda v, _: F.when(F.contains(v, F.lit("&")), once(v)).otherwise(v))


def strip_tags(c: Column | str, rules: Rules = GIVEN) -> Column:
    """Hidden elements, kind by kind, and images go; breaks and the ends of blocks are line ends, other tags spaces; entities are decoded."""
    x = _col(c)
    for tag in map(rules.letters, HIDDEN_ELEMENTS):
        x = F.regexp_replace(x, f"(?is)<{tag}(?![0-9A-Za-z_]).*?</{tag}>", " ")
    x = F.regexp_replace(x, "(?i)<img[^>]*>", " ")
    blocks = f"</(?:p|div|{rules.letters('section')}|article|main|header|footer|li|h[1-6]|tr|td|th)>"
    x = F.regexp_replace(x, f"(?i)<br[{rules.space}]*/?[{rules.space}]*>|{blocks}", "\n")
    x = F.replace(F.regexp_replace(x, "<[^>]+>", " "), F.lit("\u00a0"), F.lit(" "))
    return decode_listed(x, rules.entities) if rules.entities else decode_entities(x)


def strip_markup(c: Column | str, rules: Rules = GIVEN) -> Column:
    """Image links go, links keep their label, bare URLs go."""
    x = F.regexp_replace(_col(c), "!\\[[^\\]]*\\]\\([^)]*\\)", " ")
    x = F.regexp_replace(x, f"\\[([^\\]]*)\\]\\([{rules.space}]*(?:https?:)?//[^)]*\\)", "$1")
    return F.regexp_replace(x, f"https?://[^{rules.space}]+", " ")


def clean(c: Column | str, tags: bool = True, rules: Rules = GIVEN) -> Column:
    """Readable text: no markup, single blanks, at most one empty line in a row, trimmed."""
    x = strip_markup(strip_tags(c, rules) if tags else c, rules)
    x = F.regexp_replace(F.regexp_replace(x, "[\u200b-\u200d\ufeff]", ""), "[ \t\u00a0]{2,}|[\t\u00a0]", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, " \n ?|\n ", "\n"), "\n{3,}", "\n\n"), f"^[{rules.space}]+|[{rules.space}]+\\z", "")


def main_html(c: Column | str) -> Column:
    """The inside of the first main, else article, else body element that isn't empty; else everything."""
    x = _col(c)
    inside = F.array(*(F.regexp_extract(x, f"(?is)<{t}\\b[^>]*>(.*?)</{t}>", 1) for t in ("main", "article", "body")))
    return F.coalesce(F.get(F.filter(inside, lambda v: v != ""), F.lit(0)), x)


def page_title(c: Column | str, site: str = "", rules: Rules = GIVEN) -> Column:
    """The cleaned title element, without the site's name after a hyphen."""
    x = clean(F.regexp_extract(_col(c), "(?is)<title[^>]*>(.*?)</title>", 1), rules=rules)
    return F.regexp_replace(x, f"(?i)\\s*-\\s*{re.escape(site)}\\s*$", "") if site else x


def anchors(c: Column | str) -> Column:
    """array<struct<href, label>> of the a elements, in order; entities not decoded."""
    whole = "(?is)<a\\b[^>]*?href\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))[^>]*>(.*?)</a>"
    parts = [F.regexp_extract_all(_col(c), F.lit(whole), F.lit(k)) for k in (1, 2, 3, 4)]
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "abcd", strict=True))), lambda v: F.struct(F.concat(v["a"], v["b"], v["c"]).alias("href"), v["d"].alias("label")))


def absolute_url(href: Column | str, base: Column | str) -> Column:
    """Entity-decoded and resolved; null if empty, a fragment, of another scheme than http or https, or unreadable."""

    @F.arrow_udf("string")
    def run(hrefs: pa.Array, bases: pa.Array) -> pa.Array:
        out = []
        for h, b in zip(hrefs.to_pylist(), bases.to_pylist(), strict=True):
            v = re.sub(r"[\x00-\x1f\x7f]", "", py_decode((h or "").strip())).strip()
            found = None
            if v and v[0] != "#" and not re.match(r"(?:javascript|data|vbscript|mailto|tel|file):", v, re.I):
                try:
                    url = urljoin(b or "", v)
                    found = url if urlsplit(url).scheme in ("http", "https") and urlsplit(url).netloc else None
                except ValueError:
                    found = None
            out.append(found)
        return pa.array(out, pa.string())

    return run(_col(href), _col(base))


def query_parameter(url: Column | str, name: str) -> Column:
    """The parameter's value, empty if there is none."""
    return F.regexp_extract(_col(url), f"[?&]{re.escape(name)}=([^&#]*)", 1)


# Signs of blocked and failed pages.
BLOCKED = r"(?i)\b(Just a moment|Access Denied|Request Rejected|Enable JavaScript|Attention Required|Cloudflare|Server Error in|Runtime Error|HTTP Error 5\d\d)\b"
SOFT_ERROR = "(الصفحة غير موجودة|تعذر عرض الصفحة|حدث خطأ|لا توجد نتائج|عفواً، حدث خطأ)"
COMMENTARY_MARKS = ("مطابقته للترجمة", "مُطَابَقَتُهُ لِلتَّرْجَمَةِ", "ذكر معناه", "ذِكر معناه", r"قوله\s*[:：]", r"قَوْلُهُ\s*[:：]", "ذكر رجاله", "ذِكر رجاله", "ذكر لطائف إسناده", "ذكر تعدد موضعه", "ما يستفاد منه", "ذكر ما يستفاد منه", r"بَيَانُ(?:ت)?\s*(?:الإعراب|اللغة)")


def first_commentary(c: Column | str) -> Column:
    """Place of the earliest commentary mark, from 0; -1 without one."""
    return F.regexp_instr(_col(c), F.lit("(?:" + "|".join(COMMENTARY_MARKS) + ")")) - 1


def is_noise(line: Column) -> Column:
    """Blank, or a short line that is or begins with a label of the site's interface."""
    x = F.btrim(line)
    return (x == "") | ((F.length(x) <= 24) & F.exists(F.array(*map(F.lit, framing.UI_NOISE)), lambda m: F.startswith(x, m)))


def split_commentary(c: Column | str, least: int = 60) -> Column:
    """struct<matn, commentary, cut> of readable text: cut before the first line that opens a commentary, else before a mark late enough."""
    from .text import COMMENTARY_LINE

    tidy = lambda x: clean(x, tags=False)

    def split(x: Column) -> Column:
        lines = F.split(x, "\n")
        at = F.get(F.filter(F.sequence(F.lit(2), F.greatest(F.size(lines), F.lit(2))), lambda k: F.rlike(F.coalesce(F.get(lines, k - 1), F.lit("")), F.lit(COMMENTARY_LINE))), F.lit(0))
        by_line = F.struct(tidy(F.array_join(F.slice(lines, 1, at - 1), "\n")).alias("matn"), tidy(F.array_join(F.slice(lines, at, F.size(lines)), "\n")).alias("commentary"), F.lit(True).alias("cut"))
        mark = first_commentary(x)
        head = F.left(x, mark)
        matn = tidy(F.coalesce(F.nullif(F.regexp_extract(head, "(?s)^(.+)[ \n]", 1), F.lit("")), head))
        by_mark = F.struct(matn.alias("matn"), tidy(F.substr(x, F.length(matn) + 1)).alias("commentary"), F.lit(True).alias("cut"))
        whole = F.struct(x.alias("matn"), F.lit("").alias("commentary"), F.lit(False).alias("cut"))
        return F.when(at.isNotNull(), by_line).when((mark >= least) & (F.length(matn) >= least), by_mark).otherwise(whole)

    return let(tidy(c), split)


def truncate_at_boundary(c: Column, most: int) -> Column:
    """Cut at the last sentence or line end in the first `most` characters, if that is past their half."""
    window = F.left(c, F.lit(most))
    cut = F.length(F.regexp_extract(window, "(?s)^(.*)(?: \\. |\n|، )", 1))
    return F.when(F.length(c) <= most, c).otherwise(clean(F.when(cut > most * 0.5, F.left(window, cut)).otherwise(window), tags=False))


def error_category(message: Column | str) -> Column:
    """timeout, http-<status>, network or error, in this order."""
    x = _col(message)
    status = F.regexp_extract(x, r"HTTP (\d{3})", 1)
    network = F.rlike(x, F.lit("(?i)fetch failed|ENOTFOUND|ECONNRESET|EAI_AGAIN|socket hang up|TLS|certificate"))
    return F.when(F.rlike(x, F.lit("(?i)timeout|aborted")), "timeout").when(status != "", F.concat(F.lit("http-"), status)).when(network, "network").otherwise("error")


def retryable(category: Column | str) -> Column:
    status = F.regexp_extract(_col(category), r"^http-(\d{3})$", 1)
    return _col(category).isin("timeout", "network") | F.coalesce(status.try_cast("int") >= 500, F.lit(False)) | (status == "429")
