"""corvid.functions.matn read line by line, to hold its columns against."""

from __future__ import annotations

import re

from corvid.functions import html as H
from corvid.functions import text as X
from corvid.lexicon import framing

# Limits, and labels of the site's interface that end a commentary.
LEAST, ALIKE, WINDOW = 60, 0.6, 4000
TAIL_LABELS = ("تحليل الحديث", "الأعلام والأماكن", "مقارنة المتون", "إضافة تعليق", "الرواة")
_NUMBERED = re.compile(r"^(\d{1,5})\s*[-–—]\s*")
_OPENS = re.compile(X.COMMENTARY_LINE)
_MARK = re.compile("|".join(H.COMMENTARY_MARKS), re.I)
_STARS = re.compile(r"\*\s*\*\s*\*")
_ARABIC = re.compile(X.ARABIC)
_BLOCKED, _SOFT = re.compile(H.BLOCKED), re.compile(H.SOFT_ERROR)
_BOOK_END = re.compile(f"(?:{'|'.join(map(re.escape, framing.BOOK_SUFFIXES))})$")
_DEDUPE = str.maketrans(X.MATCH_FROM, X.MATCH_TO)


def tidy(raw: str) -> str:
    """Readable text of HTML or text, as H.clean() makes it."""
    x = re.sub(H.HIDDEN, " ", raw)
    x = re.sub(r"(?i)<br\s*/?\s*>|</(?:p|div|section|article|main|header|footer|li|h[1-6]|tr|td|th)>", "\n", x)
    x = H.py_decode(re.sub("<[^>]+>", " ", x).replace(" ", " "))
    x = re.sub(r"https?://\S+", " ", re.sub(r"\[([^\]]*)\]\(\s*(?:https?:)?//[^)]*\)", r"\1", re.sub(r"!\[[^\]]*\]\([^)]*\)", " ", x)))
    x = re.sub("[ \t ]+", " ", re.sub("[​-‍﻿]", "", x))
    return re.sub("\n{3,}", "\n\n", re.sub(" ?\n ?", "\n", x)).strip()


def key(text: str) -> str:
    """X.dedupe_form() of one text."""
    x = re.sub(f"[{X.WIDE_MARKS}]", "", text).translate(_DEDUPE)
    return re.sub("[^؀-ۿݐ-ݿ]+", " ", x).strip()


def alike(needle: str, haystack: str) -> float:
    words = [t for t in key(needle).split() if len(t) >= 3]
    have = set(key(haystack).split())
    return sum(w in have for w in words) / len(words) if words else 1.0


def main(page: str) -> str:
    for tag in ("main", "article", "body"):
        if (m := re.search(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", page)) and m[1]:
            return m[1]
    return page


def noise(line: str) -> bool:
    x = line.strip()
    return not x or (len(x) <= 24 and x.startswith(framing.UI_NOISE))


def once(lines: list[str]) -> list[str]:
    """Without lines that have no form, and without later copies of long ones."""
    seen, out = set(), []
    for line in lines:
        k = key(line)
        if k and not (len(k) >= LEAST and k in seen):
            seen.add(k)
            out.append(line)
    return out


def snippet(title: str) -> str:
    """A result title's words: no ordinal, no book name, no final punctuation."""
    lines = [v.strip() for v in tidy(title).split("\n") if v.strip()]
    if not lines:
        return ""
    m = re.match(r"^(\d{1,5})\s*[-–—:]\s*(.*)$", lines[0])
    head = m[2].strip() if m else lines[0]
    if not head:
        head = next((v for v in lines if not re.match(r"^\d{1,5}\s*[-–—:]\s*$", v)), " ".join(lines))
    return re.sub(r"[،,:;\s]+$", "", _BOOK_END.sub("", _NUMBERED.sub("", head).strip()).strip())


def split(text: str) -> tuple[str, str]:
    """(matn, commentary): before the first line that opens a commentary, else before a late enough mark, at a word's end."""
    x = tidy(text)
    lines = x.split("\n")
    for k in range(1, len(lines)):
        if _OPENS.match(lines[k]) and (matn := tidy("\n".join(lines[:k]))):
            return matn, tidy("\n".join(lines[k:]))
    if (m := _MARK.search(x)) and m.start() >= LEAST:
        head = x[: m.start()]
        cut = max(head.rfind(" "), head.rfind("\n"))
        matn = tidy(head[:cut] if cut > 0 else head)
        if len(matn) >= LEAST:
            return matn, tidy(x[len(matn) :])
    return x, ""


def extract(page_text: str, hint: str = "") -> dict:
    """number, matn, commentary, matched: the numbered line most like the hint and the lines that belong to it.

    Without a numbered line, a window from where the hint stands in the text.
    """
    whole = tidy(page_text)
    lines, wanted = [v.strip() for v in whole.split("\n") if v.strip()], key(hint)
    found = []
    for k, line in enumerate(lines):
        m = _NUMBERED.match(line)
        body = line[m.end() :].strip() if m else ""
        if m and not noise(line) and len(body) >= 40 and _ARABIC.search(body):
            found.append((alike(hint, body) if wanted else 0.0, -k, m[1], body))
    if not found:
        at = whole.find(hint.strip()) if wanted else -1
        if at < 0:
            return {"number": "", "matn": "", "commentary": "", "matched": False}
        kept = once([v for v in tidy(whole[max(0, at - 40) : at + WINDOW]).split("\n") if not noise(v) and _ARABIC.search(v)])
        matn, commentary = split(_NUMBERED.sub("", tidy("\n".join(kept))))
        return {"number": "", "matn": matn, "commentary": commentary, "matched": True}
    good = [c for c in found if c[0] >= ALIKE]
    _, at, number, body = max(good) if good else found[0]
    block = [body]
    for line in lines[1 - at :]:
        if noise(line) or _NUMBERED.match(line) or line == "* * *" or _OPENS.match(line):
            break
        if _ARABIC.search(line):
            block.append(line)
    matn, commentary = split(tidy("\n".join(once(block))))
    return {"number": number, "matn": matn, "commentary": commentary, "matched": alike(hint, matn) >= ALIKE if wanted else True}


def truncate(text: str, most: int) -> str:
    if not most or len(text) <= most:
        return text
    window = text[:most]
    cut = max(window.rfind(" . "), window.rfind("\n"), window.rfind("، "))
    return tidy(window[:cut] if cut > most * 0.5 else window)


def explanation(page: str, most: int = 6000) -> str:
    """The commentary of a service page: after the separator, from its first mark, without the interface's tail."""
    text = tidy(main(page))
    if m := _STARS.search(text):
        text = text[m.end() :]
    if not (m := _MARK.search(text)):
        return ""
    body = tidy(text[m.start() :])
    for label in TAIL_LABELS:
        if (at := body.rfind(label)) > 400:
            body = body[:at]
    body = body.strip()
    return truncate(body, most) if len(key(body)) >= LEAST else ""


def references(page: str, wanted: str, parameter: str) -> int:
    return len(re.findall(rf"(?i){parameter}={re.escape(wanted)}(?![0-9])", page))


def _parameter(url: str, parameter: str) -> str:
    m = re.search(rf"(?i)[?&]{parameter}=([^&#]*)", url or "")
    return m[1] if m else ""


def detail(page: str | None, url: str | None, title: str | None, parameter: str = "mainId", most: int = 6000) -> dict:
    """reason (null for a usable page), number, matn, explanation: the checks of a detail page, in their order."""
    out = {"reason": None, "number": "", "matn": "", "explanation": ""}
    page, hint = page or "", snippet(title or "")
    text = tidy(main(page))
    wanted = _parameter(url, parameter)
    if not page.strip():
        reason = "empty-response"
    elif _BLOCKED.search(page):
        reason = "block-page"
    elif not _ARABIC.search(text):
        reason = "no-arabic-content"
    elif _SOFT.search(text) and len(text) < 900:
        reason = "site-error-page"
    elif wanted and references(page, wanted, parameter) < 2:
        reason = f"page-does-not-reference-{parameter}-{wanted}"
    else:
        found = extract(text, hint)
        said = explanation(page, most) if _STARS.search(text) or _MARK.search(text) else ""
        if not said and len(key(found["commentary"])) >= LEAST:
            said = truncate(found["commentary"], most)
        out |= {"number": found["number"], "matn": found["matn"], "explanation": said}
        reason = "no-matn-extracted" if not found["matn"] else "matn-too-short" if len(found["matn"]) < LEAST else "matn-does-not-match-result-excerpt" if hint and not found["matched"] else None
    return out | {"reason": reason}


def commentary(page: str | None, url: str | None, parameter: str = "mainId", most: int = 6000) -> dict:
    """reason (null for a usable page) and explanation of a commentary page."""
    page = page or ""
    text, wanted = tidy(main(page)), _parameter(url, parameter)
    said = explanation(page, most)
    if len(text) < 200 or not _ARABIC.search(text) or _BLOCKED.search(text):
        reason = "not-a-commentary-page"
    elif not _MARK.search(text):
        reason = "no-commentary-markers"
    elif not said:
        reason = "no-explanation-extracted"
    elif wanted and references(page, wanted, parameter) < 1:
        reason = "commentary-does-not-reference-itself"
    else:
        reason = None
    return {"reason": reason, "explanation": "" if reason else said}
