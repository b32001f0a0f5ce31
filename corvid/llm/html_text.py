"""Main text of HTML pages by a tree-structured graphical model over DOM nodes.

Each node is content or not. Its own features give a unary potential, each parent-child edge a pairwise one. Messages go up
from the leaves and down from the root (sum-product), which gives every node's exact marginal. Both kinds of potential are
learned from labelled pages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))|[^>])*+)(?:>|$)", re.S)
#: Elements without text of the page; those of the first kind hold no tags and run to the end of the page if they aren't closed.
_RAW = frozenset("title script style textarea".split())
_HIDDEN = _RAW | frozenset("template svg iframe select button".split())
_BLOCK = frozenset(
    "html head body article section main div p ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 pre blockquote "
    "figure figcaption header footer nav aside form fieldset legend label address details summary hr center dialog menu".split()
)
_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|$)", re.I) for t in _HIDDEN}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening the key ends an open element of the values, if it is the nearest block.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "body": {"head", "title"}}
_ENDS |= {t: {"p"} for t in _BLOCK - {"html", "head", "body", "title", "p", "li", "dt", "dd", "tr", "td", "th"}}
_GOOD = re.compile(r"\b(?:article|content|main|post|story|entry|body|text|paragraph)", re.I)
_BAD = re.compile(r"\b(?:nav|menu|foot|head(?:er)?\b|side|ads?\b|advert|banner|sponsor|promo|cookie|consent|notice|popup|modal|comment|respond|reply|disqus|share|social|related|recommend|breadcrumb|subscribe|newsletter|login|search|pagination|pager|tags?\b|meta\b|widget)", re.I)
_STOP = re.compile(r"[.!?…:;](?:\s|$)")
TAGS = ("text", "p", "h", "li", "td", "div", "section", "article", "main", "body", "html", "head", "title", "header", "footer", "nav", "aside", "form", "list", "table", "quote", "other")
_TAG = {t: n for n, t in enumerate(TAGS)} | {f"h{k}": 2 for k in range(1, 7)} | {"ul": 18, "ol": 18, "dl": 18, "menu": 18, "tr": 19, "tbody": 19, "thead": 19, "th": 4, "dt": 3, "dd": 3, "pre": 20, "blockquote": 20, "label": 17, "fieldset": 17, "legend": 17, "dialog": 16, "address": 14}
WIDTH = len(TAGS) + 8


@dataclass
class Node:
    tag: str
    parent: int
    good: bool = False
    bad: bool = False
    raw: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    size: int = 0
    links: int = 0


def parse(page: str) -> list[Node]:
    """Block elements and their runs of text, in page order; a parent comes before its children. Linear in the page."""
    nodes, stack, run, at, links = [Node("html", -1)], [0], -1, 0, 0
    open_: Counter[str] = Counter()
    unclosed: set[str] = set()

    def close(k: int):
        for n in stack[k:]:
            open_[nodes[n].tag] -= 1
        del stack[k:]

    def text(s: str):
        nonlocal run
        if s and (run >= 0 or not s.isspace()):
            if run < 0:
                nodes.append(Node("text", stack[-1]))
                run = len(nodes) - 1
            nodes[run].raw.append(s)
            if links:
                nodes[run].linked += len(s)

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _HIDDEN:
            if not closing and not m[3].endswith("/"):
                end = None if tag in unclosed else _END[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in _RAW:
                    at = len(page)
                else:
                    unclosed.add(tag)
        elif tag == "br":
            text(" ") if run >= 0 else None
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in _BLOCK:
            run = -1
            if closing:
                if open_[tag]:
                    k = len(stack) - 1
                    while nodes[stack[k]].tag != tag:
                        k -= 1
                    close(k)
                    links = 0
            else:
                while len(stack) > 1 and nodes[stack[-1]].tag in _ENDS.get(tag, ()):
                    close(len(stack) - 1)
                if tag == "html":
                    continue
                attributes = " ".join(re.findall(r"(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", m[3], re.I)).replace("_", "-").replace("-", " ") if m[3].strip() else ""
                nodes.append(Node(tag, stack[-1], bool(_GOOD.search(attributes)), bool(_BAD.search(attributes))))
                if tag not in _VOID:
                    stack.append(len(nodes) - 1)
                    open_[tag] += 1
    text(page[at:])
    for n in reversed(nodes):
        if n.tag == "text":
            n.text = " ".join(html.unescape("".join(n.raw)).split())
            n.size, n.links = len(n.text), n.linked
        n.raw = []
        if n.parent >= 0:
            nodes[n.parent].size += n.size
            nodes[n.parent].links += n.links
    return nodes


def features(n: Node) -> list[tuple[int, float]]:
    """Index and value of the features that aren't 0."""
    base = len(TAGS)
    out = [(_TAG.get(n.tag, 21), 1.0), (base, 1.0), (base + 1, min(n.size, 80) / 80 if n.tag == "text" else 0.0), (base + 2, min(1.0, n.links / n.size) if n.size else 0.0)]
    if n.good:
        out.append((base + 3, 1.0))
    if n.bad:
        out.append((base + 4, 1.0))
    if n.tag == "text":
        if _STOP.search(n.text):
            out.append((base + 5, 1.0))
        if "©" in n.text[:40]:
            out.append((base + 6, 1.0))
        if n.size < 25:
            out.append((base + 7, 1.0))
    return out


@dataclass
class TreeModel:
    unary: np.ndarray
    #: log potentials by the child's tag class: rows parent label, columns child label.
    edges: dict[int, tuple[float, float, float, float]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, by one upward and one downward sweep in log odds."""
        w = self.unary.tolist()
        own = [sum(w[i] * v for i, v in features(n)) for n in nodes]
        up, to_parent = own[:], [0.0] * len(nodes)
        edge = [self.edges.get(_TAG.get(n.tag, 21), (0.0, 0.0, 0.0, 0.0)) for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            a, b, c, d = edge[k]
            to_parent[k] = _lse(c, d + up[k]) - _lse(a, b + up[k])
            up[nodes[k].parent] += to_parent[k]
        full = up[:]
        for k in range(1, len(nodes)):
            a, b, c, d = edge[k]
            rest = full[nodes[k].parent] - to_parent[k]
            full[k] = up[k] + _lse(b, d + rest) - _lse(a, c + rest)
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in full]


def _lse(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def train(pages: list[tuple[str, str]], steps: int = 12) -> TreeModel:
    """pages: (html, main text). A node is content if most of its text is lines of the main text.

    Unary weights are fitted by logistic regression; a pairwise potential is the log ratio of how often parent and child
    labels occur together to how often they would by chance, by the child's tag class, with add-one counts.
    """
    x, y, pairs = [], [], {}
    for page, main in pages:
        nodes, lines = parse(page), set(main.split("\n"))
        good = [n.size if n.tag == "text" and n.text in lines else 0 for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            good[nodes[k].parent] += good[k]
        label = [int(n.size and 2 * g > n.size) for n, g in zip(nodes, good, strict=True)]
        for k, n in enumerate(nodes):
            row = np.zeros(WIDTH)
            for i, v in features(n):
                row[i] = v
            x.append(row)
            y.append(label[k])
            if k:
                pairs.setdefault(_TAG.get(n.tag, 21), np.ones((2, 2)))[label[n.parent], label[k]] += 1
    x, y = np.array(x), np.array(y, float)
    w = np.zeros(WIDTH)
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(WIDTH), x.T @ (y - p) - 0.1 * w)
    edges = {}
    for tag, c in pairs.items():
        p = c / c.sum()
        edges[tag] = tuple(float(v) for v in np.log(p / np.outer(p.sum(1), p.sum(0))).ravel())
    return TreeModel(w, edges)


def labelled_pages(n: int, seed: int = 5) -> list[tuple[str, str]]:
    """Invented pages of several layouts with their main text, for training and tests."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ka", "lo", "mi", "ter", "an", "os", "re", "un")) for _ in range(r.randint(1, 4)))
    sentence = lambda lo=4, hi=18: " ".join(word() for _ in range(r.randint(lo, hi))).capitalize() + r.choice(".....!?")
    heading = lambda lo, hi: r.choice((sentence(lo, hi), sentence(lo, hi)[:-1], sentence(lo, hi)[:-1], " ".join(sentence(lo, hi)[:60].split())))
    link = lambda: f'<a href="/{word()}">{word().title()}</a>'
    items = lambda: "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 8)))
    short = lambda: r.choice((sentence(2, 8), sentence(5, 14) + " " + sentence(3, 9)))
    out = []
    for _ in range(n):
        before = [f"<nav><ul>{items()}</ul></nav>", f'<div class="menu"><ul>{items()}</ul></div>', f"<header><h1>{word().title()}</h1><p>{short()}</p></header>", f'<div class="{r.choice(("ad", "advert", "ads banner", "sponsor"))}">{short()}</div>', f'<div id="{r.choice(("cookie-notice", "consent"))}"><p>{short()}</p><button>OK</button></div>', f'<form action="/s"><label>{word()}</label><input name="q"></form>']
        after = [f"<footer>&copy; {word()}.com &middot; {short()}</footer>", f'<div class="footer"><p>&copy; {word()} {short()}</p></div>', f'<aside><h3>{word()}</h3><ul>{items()}</ul><p>{short()}</p></aside>', f'<div class="sidebar"><p>{short()}</p><ul>{items()}</ul></div>', f'<section class="comments"><h3>{word()}</h3>' + "".join(f'<div class="comment"><p>{short()}</p></div>' for _ in range(r.randint(1, 4))) + "</section>", f'<div class="related"><ul>{items()}</ul></div>']
        blocks, lines = [], []
        brief = r.random() < 0.2  # an article of a few words
        if r.random() < 0.8:
            lines.append(heading(1, 3) if brief else heading(3, 14))
            blocks.append(f"<h1>{lines[-1]}</h1>")
        for _ in range(r.choice((1, 1, 2) if brief else (1, 1, 2, 2, 3, 5, 8))):
            kind = r.random()
            if kind < 0.08:
                lines += (rows := [sentence(2, 9) for _ in range(r.randint(2, 4))])
                blocks.append("<ul>" + "".join(f"<li>{v}</li>" for v in rows) + "</ul>")
            elif kind < 0.14:
                lines.append(heading(1, 6))
                blocks.append(f"<h2>{lines[-1]}</h2>")
            elif kind < 0.18:
                lines.append(sentence())
                blocks.append(f"<blockquote>{lines[-1]}</blockquote>")
            else:
                lines.append(sentence(1, 5) if brief else " ".join(sentence(2, 18) for _ in range(r.choice((1, 1, 2, 3, 4, 6)))))
                if r.random() < 0.15:
                    lines[-1] = lines[-1].replace(" ", r.choice((" | ", "### ", " * ", "!! "))).rstrip(".!?")
                body = lines[-1] if r.random() < 0.7 else re.sub(r"^(\w+)", r"<b>\1</b>", lines[-1])
                blocks.append(f"<p>{body}" + ("</p>" if r.random() < 0.8 else ""))
                if r.random() < 0.1:
                    blocks.append(f'<div class="{r.choice(("ad", "advert"))}">{short()}</div>')
        wrap = r.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><article>{}</article></div>', '<div class="post-body">{}</div>', "<div>{}</div>"))
        parts = [*r.sample(before, r.randint(1, 4)), wrap.format("".join(blocks)), *r.sample(after, r.randint(1, 4))]
        if r.random() < 0.1:  # a fragment
            out.append(("".join(parts), "\n".join(lines)))
            continue
        out.append((f"<!DOCTYPE html><html><head><title>{r.choice((lines[0], lines[0][:60], sentence(), word()))}</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>", "\n".join(lines)))
    return out


@lru_cache(maxsize=1)
def model(n: int = 600) -> TreeModel:
    return train(labelled_pages(n))


def main_text(page: str | None, tree: TreeModel) -> str:
    nodes = parse(page or "")
    return "\n".join(n.text for n, p in zip(nodes, tree.marginals(nodes), strict=True) if n.tag == "text" and n.text and p > 0.5)


def extract(pages: DataFrame, html_col: str = "html", tree: TreeModel | None = None) -> DataFrame:
    """pages without html_col, with text: the main text, blocks joined by a line end, and n_chars, its code points.

    A null or empty page, or one without main text, gives an empty text. Empty table: empty result. Repeated rows give
    equal texts. A block at even odds isn't content. Columns text and n_chars are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(tree or model())

    @F.arrow_udf("string")
    def run(page: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), shared.value) for p in page], pa.string())

    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    x = pages.select(*kept, run(text_or_empty(html_col)).alias("text"))
    return x.withColumn("n_chars", F.length("text").cast("long"))
