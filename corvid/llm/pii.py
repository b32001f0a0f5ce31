"""Personal data: exact base patterns, and candidate spans chosen by boosted trees."""

from __future__ import annotations

import bisect
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, text_or_empty

#: Kinds of the base patterns; the method proposes spans of these and credentials.
KINDS = ("email", "ip", "card", "phone")
PROPOSED = (*KINDS, "secret")
_ORDER = {k: n for n, k in enumerate(PROPOSED)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")  # a secret holds a digit
SPAN = "array<struct<kind: string, start: int, end: int, base: boolean, score: double>>"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Round each @, as neither side can hold one: linear in the text."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(floor, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the contract's patterns, by start and then kind."""
    out = [(s, e, "email") for s, e in emails(text)]
    if _DIGITS.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := "".join(_DIGITS.findall(m[0]))) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], _ORDER[x[2]]))


#: Wide patterns that propose spans; most of what they find is nothing personal. All runs are bounded.
PROPOSALS = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\s?(?:@|[\[(]at[\])])\s?[\w-]{1,63}(?:\s?(?:\.|[\[(]dot[\])])\s?[\w-]{1,63}){1,4}"),
    "ip": re.compile(r"(?<![\w.])(?:[0-9]{1,3}(?:\s?[.\[\]]{1,3}\s?[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7})(?![\w.]\w)"),
    "card": re.compile(r"(?<![\w])[0-9]{4}(?:[ ./_-]?[0-9]{3,6}){2,4}(?!\w)"),
    "phone": re.compile(r"(?<![\w+])(?:00|\(|[0-9])[0-9]{0,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,8}\)?){1,5}(?!\w)"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+.@-])(?=[A-Za-z_/+-]{0,40}[0-9])(?=[0-9_/+-]{0,40}[A-Za-z])[A-Za-z0-9_/+-]{12,128}={0,2}(?![A-Za-z0-9_/+@-])"),
}
_CUES = (
    re.compile(r"(?:phone|tel|telefon|t[ée]l[ée]phone|tel[ée]fono|call|mobile|handy|fax|whatsapp|number|nummer|num[ée]ro|reach|ring|dial)\W{0,3}\w{0,3}\W{0,3}$", re.I),
    re.compile(r"(?:mail|e-mail|courriel|correo|contact|kontakt|write)\W{0,3}\w{0,3}\W{0,3}$", re.I),
    re.compile(r"(?:card|visa|mastercard|karte|carte|tarjeta|credit|pan)\W{0,3}\w{0,6}\W{0,3}$", re.I),
    re.compile(r"(?:ip|host|server|address|adresse|ping|ssh|from)\W{0,3}\w{0,3}\W{0,3}$", re.I),
    re.compile(r"(?:version|v|isbn|order|no|nr|id|page|chapter|total|sum|year|date|on|in|ticket|part|license)\W{0,3}$", re.I),
    re.compile(r"(?:password|passwd|pwd|passwort|contrase[ñn]a|secret|token|api.?key|access.?key|key|credentials?|auth|bearer)\W{0,4}$", re.I),
    re.compile(r"(?:commit|sha-?[0-9]{0,3}|md5|digest|checksum|hash|uuid|guid|etag|file|model|revision|build)\W{0,4}$", re.I),
)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a proposed span."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 1]
    digits = "".join(_DIGITS.findall(s))
    groups = re.findall(r"[0-9]+", s)
    return [
        *(float(kind == k) for k in PROPOSED), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(12 <= len(digits) <= 19 and luhn(digits)) if digits else 0.0, float(all(int(g) <= 255 for g in groups[:8])), float(s[:2] == "00"), float(s[0] == "("),
        s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count(":"), float("@" in s), float("at]" in s or "at)" in s), sum(c.isalpha() for c in s),
        float(bool(re.match(r"(?:19|20)[0-9]{2}\D", s))), float(before[-1:].isalnum()), float(before[-1:] in "$€£#"), float(after in "%$€"), sum(c.isupper() for c in s), sum(c.islower() for c in s), s.count("_"),
        sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False)), len(set(s)) / len(s), float(all(c in "0123456789abcdef" for c in s)), *(float(bool(c.search(before))) for c in _CUES),
    ]


@dataclass
class Trees:
    """Additive depth-limited trees on raw features, a logistic calibration of their sum, and a threshold a kind."""

    trees: list[list[tuple]]
    rate: float
    scale: tuple[float, float]
    thresholds: dict[str, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            out += self.rate * _apply(tree, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.raw(x) + self.scale[1])))


def _apply(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    for _ in range(8):
        node = np.array([t[:4] for t in tree])[at]
        inner = node[:, 0] >= 0
        if not inner.any():
            break
        right = x[np.arange(len(x)), np.maximum(node[:, 0], 0).astype(int)] > node[:, 1]
        at = np.where(inner, np.where(right, node[:, 3], node[:, 2]).astype(int), at)
    return np.array([t[4] for t in tree])[at]


def _grow(x, g, h, rows, depth, tree):
    me = len(tree)
    tree.append((-1, 0.0, 0, 0, float(g[rows].sum() / (h[rows].sum() + 1.0))))
    if depth == 0 or len(rows) < 20:
        return me
    best, total_g, total_h = (1e-3, None, None), g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        for cut in np.unique(x[rows, f])[:-1][:40]:
            right = x[rows, f] > cut
            gr, hr = g[rows][right].sum(), h[rows][right].sum()
            gain = gr**2 / (hr + 1) + (total_g - gr) ** 2 / (total_h - hr + 1) - total_g**2 / (total_h + 1)
            if gain > best[0]:
                best = (gain, f, cut)
    if best[1] is not None:
        right = x[rows, best[1]] > best[2]
        low, high = _grow(x, g, h, rows[~right], depth - 1, tree), _grow(x, g, h, rows[right], depth - 1, tree)
        tree[me] = (best[1], float(best[2]), low, high, 0.0)
    return me


def boost(x: np.ndarray, y: np.ndarray, kinds: list[str], rounds: int = 30, depth: int = 3, rate: float = 0.3, precision: float = 0.97) -> Trees:
    """Logistic boosting on two thirds of the examples; a sixth calibrates, and another one sets the thresholds."""
    fit_rows = np.arange(len(x)) % 3 != 0
    model, score = Trees([], rate, (1.0, 0.0), {}), np.zeros(fit_rows.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree: list[tuple] = []
        _grow(x[fit_rows], y[fit_rows] - p, np.maximum(p * (1 - p), 1e-6), np.arange(fit_rows.sum()), depth, tree)
        model.trees.append(tree)
        score += rate * _apply(tree, x[fit_rows])
    calibration, rest = np.arange(len(x)) % 6 == 0, np.arange(len(x)) % 6 == 3
    raw, truth = model.raw(x[calibration]), y[calibration]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling
        p = 1 / (1 + np.exp(-(a * raw + b)))
        a, b = a - 0.05 * np.mean((p - truth) * raw), b - 0.05 * np.mean(p - truth)
    model.scale = (float(a), float(b))
    p, kind, truth = model.probability(x[rest]), np.array(kinds)[rest], y[rest]
    for k in PROPOSED:
        cuts = sorted(set(p[kind == k]))
        good = [c for c in cuts if truth[(kind == k) & (p >= c)].mean() >= precision and c >= 0.5]
        model.thresholds[k] = float(min(good, default=0.99))
    return model


HEX, UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
ALNUM = UPPER + "abcdefghijklmnopqrstuvwxyz"


def examples(n: int, seed: int = 11) -> tuple[list[str], list[tuple[int, int, str]], list[int]]:
    """Invented sentences with one written-out datum each (label 1) or one that only looks like it (label 0)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice(("an", "er", "ti", "on", "re", "la", "ou", "st")) for _ in range(r.randint(1, 4)))
    b = lambda k, letters: "".join(r.choice(letters) for _ in range(k))
    own = {
        "phone": lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}", f"0{d(3)} {d(6)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)}/{d(5)}", f"0{d(2)} {d(6)}", f"0{d(3)}/{d(7)}", f"({d(3)}) {d(4)}-{d(3)}", f"{d(3)}.{d(3)}.{d(4)}")),
        "email": lambda: f"{w()}{r.choice(('.', '', '_'))}{w()} {r.choice(('[at]', '(at)'))} {w()} {r.choice(('[dot]', '(dot)', '.'))} {r.choice(('com', 'org', 'de', 'fr'))}",
        "card": lambda: r.choice((f"{d(4)}.{d(4)}.{d(4)}.{d(4)}", f"{d(4)}/{d(4)}/{d(4)}/{d(4)}", f"{d(4)}_{d(4)}_{d(4)}_{d(4)}")),
        "secret": lambda: r.choice((f"AKIA{b(16, UPPER)}", f"ghp_{b(36, ALNUM)}", b(r.choice((16, 18, 24, 32, 40)), HEX), b(r.choice((20, 32, 40)), ALNUM), b(30, ALNUM + "/+") + "==", f"{w()}{d(4)}{w()}{d(2)}")),
        "ip": lambda: r.choice((":".join(f"{r.getrandbits(16):x}" for _ in range(8)), f"{r.randint(1, 255)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}")),
    }
    other = {
        "phone": lambda: r.choice((f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{d(2)}/{d(2)}/{r.randint(1900, 2030)}", f"{d(1)}.{d(2)}.{d(2)}", f"{d(2)} {d(3)} {d(3)}", f"{d(3)}-{d(1)}-{d(2)}-{d(5)}")),
        "email": lambda: f"{w()} (at) {w()}. {w().title()}",
        "card": lambda: r.choice((f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(3)}-{d(4)}", f"{d(4)}{d(6)}{d(5)}")),
        "secret": lambda: r.choice((f"{b(8, HEX)}-{b(4, HEX)}-{b(4, HEX)}-{b(4, HEX)}-{b(12, HEX)}", b(40, HEX), b(64, HEX), f"{w()}_{w()}_{w()}{d(1)}", f"{w()}-{w()}{w()}-{d(4)}", f"{w()}/{w()}/{w()}{d(2)}", f"{w().upper()}{d(3)}-{d(6)}", f"{w()}{w()}{w()}{d(2)}")),
        "ip": lambda: r.choice((f"{d(1)}. {d(1)}. {d(2)}. {d(3)}", "1:2:3:4", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"{r.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}")),
    }
    cue = {"secret": ("password=", 'token = "', "api_key: ", "secret ", "access key ", "bearer "), "phone": ("Tel: ", "call ", "phone ", "number is ", "reach me: ", ""), "email": ("mail ", "contact: ", ""), "card": ("card ", "Visa ", "credit card: "), "ip": ("host ", "server ", "from ", "", "")}
    names = ("commit ", "sha256 ", "uuid ", "file ", "model ", "digest: ", "see ", "")
    off = ("version ", "total ", "order ", "on ", "ISBN ", "page ", "", "", "")
    texts, spans, labels = [], [], []
    for i in range(n):
        kind, label = PROPOSED[i % len(PROPOSED)], (i // len(PROPOSED)) % 2
        value = (own if label else other)[kind]()
        plain = off if kind != "secret" else names
        known = value.startswith(("AKIA", "ghp_"))
        lead = " ".join(w() for _ in range(r.randint(0, 6))) + " " + r.choice(("", *cue[kind]) if known else cue[kind] if label or (kind != "secret" and r.random() < 0.1) else plain)
        texts.append(lead + value + r.choice((" ", ". ", ", ")) + " ".join(w() for _ in range(r.randint(1, 6))))
        spans.append((len(lead), len(lead) + len(value), kind))
        labels.append(label)
    return texts, spans, labels


@lru_cache(maxsize=1)
def model(n: int = 4500) -> Trees:
    """Trained here, on n invented examples; the spans compared are those that the proposals find in them."""
    texts, spans, labels = examples(n)
    x, y, kinds = [], [], []
    for text, (start, end, own), label in zip(texts, spans, labels, strict=True):
        for kind, pattern in PROPOSALS.items():
            for m in pattern.finditer(text):
                overlap = max(0, min(end, m.end()) - max(start, m.start()))
                x.append(features(text, *m.span(), kind))
                y.append(float(label and kind == own and overlap >= 0.8 * max(end - start, m.end() - m.start())))
                kinds.append(kind)
    return boost(np.array(x), np.array(y), kinds)


class Intervals:
    """Disjoint intervals in order; those that overlap are joined."""

    def __init__(self):
        self.starts, self.ends = [], []

    def _range(self, start: int, end: int) -> tuple[int, int]:
        return bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)

    def meets(self, start: int, end: int) -> bool:
        a, b = self._range(start, end)
        return a < b

    def add(self, start: int, end: int) -> None:
        a, b = self._range(start, end)
        if a < b:
            start, end = min(start, self.starts[a]), max(end, self.ends[b - 1])
        self.starts[a:b], self.ends[a:b] = [start], [end]


def find(texts: list[str | None], trees: Trees) -> list[list[dict]]:
    """The spans of each text, by start and then kind; added ones never overlap others."""
    out: list[list[dict]] = []
    waiting, rows = [], []
    for n, text in enumerate(texts):
        text = text or ""
        if not _TRIGGER.search(text):
            out.append([])
            continue
        base = base_spans(text)
        out.append([{"kind": k, "start": s, "end": e, "base": True, "score": 1.0} for s, e, k in base])
        taken = Intervals()
        for s, e, _ in base:
            taken.add(s, e)
        for kind, pattern in PROPOSALS.items():
            if kind == "email" and "@" not in text and "at]" not in text and "at)" not in text:
                continue
            for m in pattern.finditer(text):
                s, e = m.span()
                if not taken.meets(s, e):
                    waiting.append((n, s, e, kind))
                    rows.append(features(text, s, e, kind))
    if rows:
        p = trees.probability(np.array(rows))
        chosen: dict[int, Intervals] = {}
        for (n, s, e, kind), score in sorted(zip(waiting, p, strict=True), key=lambda x: -x[1]):
            mine = chosen.setdefault(n, Intervals())
            if score >= trees.thresholds[kind] and not mine.meets(s, e):
                mine.add(s, e)
                out[n].append({"kind": kind, "start": s, "end": e, "base": False, "score": float(score)})
        for n in chosen:
            out[n].sort(key=lambda x: (x["start"], _ORDER[x["kind"]]))
    return out


def with_spans(docs: DataFrame, text_col: str = "text", trees: Trees | None = None, name: str = "pii") -> DataFrame:
    """docs with the column name, the array of its spans in code points (kind, start, end, base, score).

    A null text is empty and has none. Empty table: empty result. Repeated rows have equal spans. Spans of different
    kinds of the base may overlap; of overlapping proposals the most probable stays. A column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees or model())
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        claim("pii")
        out = []
        for at in range(0, len(texts), 256):
            out += find(texts.slice(at, 256).to_pylist(), shared.value)
        return pa.array(out, arrow)

    return docs.withColumn(name, spans(text_or_empty(text_col)))


def redacted(text: str | None, found: list[dict]) -> str | None:
    """text with each span replaced by its kind in angle brackets; overlapping ones together, by the first one's kind."""
    at, parts = 0, []
    for s in found:
        if s["start"] >= at:
            parts += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join(parts) + text[at:] if parts else text


def redact(docs: DataFrame, text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; n_chars follows where there is such a column.

    Overlapping spans are replaced together, by the first one's kind. A null text stays null. Texts visit Python once. Columns keep their names,
    whatever these are. Empty table: empty result. Repeated rows: each is redacted alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees or model())
    kind = pa.struct([("text", pa.string()), ("changed", pa.bool_())])

    @F.arrow_udf("struct<text: string, changed: boolean>")
    def cut(texts: pa.Array) -> pa.Array:
        claim("pii")
        out = []
        for at in range(0, len(texts), 256):
            part = texts.slice(at, 256).to_pylist()
            out += [{"text": redacted(t, f), "changed": bool(f)} for t, f in zip(part, find(part, shared.value), strict=True)]
        return pa.array(out, kind)

    x = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), cut(F.col(f"`{text_col}`")).alias("cut"))  # no column's name can clash
    new = {text_col: F.col("cut.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut.changed"), F.length("cut.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return x.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
