"""Pages that the tables don't hold, cleaned as SQL cleans them."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvid.functions import html as H
from corvid.plans import queries

from . import oracle
from .test_queries import SMALL
from .test_text import one

BITS = (
    "a", "B", " ", "\n", "\n\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\u00a0", "\u2028", "\u200b", "\ufeff", "\u3000", "é", "\x00", "\U0001d4b3", "&", "&amp;", "&amp", "&amp;amp;amp;lt;", "&lt;", "&LT;",
    "&quot;", "&apos;", "&nbsp;", "&nbsp", "&copy;", "&middot;", "&eacute;", "&hellip;", "&#65;", "&#x41;", "&quo", "=", ";", "<", ">", "<p>", "</p>", "<br\x0b>", "<BR />", "</h1>", "<script>", "</script>", "<SCRIPT src=x>",
    "<style>", "</style>", "<noscript>", "</noscript>", "<svg>", "</svg>", "<\u017fcript>", "</\u017fcript>", "<scripté>", "<IMG\n>", "</\u017fection>", "<title>", "</TITLE>", "http://x.y/z", "HTTP://Q", "![i](u)", "[l](//x)", "[l]( \x0bhttps://x)",
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Odd pages beside the other small tables."""
    rng, d = random.Random(8), tmp_path_factory.mktemp("odd")
    rows = [None, "", " ", "<title></title>", "no title"]
    for n in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 18)))
        rows.append(f"<title>{text}</title>x" if n % 2 else text)
    pq.write_table(pa.table({"page_id": pa.array(range(len(rows)), pa.int64()), "url": ["http://h/"] * len(rows), "html": pa.array(rows, pa.string())}), d / "pages.parquet")
    for t in oracle.TABLES:
        if t != "pages":
            os.symlink(f"{SMALL}/{t}.parquet", d / f"{t}.parquet")
    return str(d)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["html_clean", "html_title"])
def test_odd_pages_equal_the_oracle(spark, folder, name):
    got = [tuple(r) for r in queries.QUERIES[name](spark, folder).collect()]
    want = oracle.expected(queries.ORACLES[name], folder)
    want = [(i, None if t is None or t != t else t) for i, t in want.itertuples(index=False)]
    assert sorted(got) == sorted(want)


def test_kinds_of_hidden_elements_go_one_after_the_other(spark):
    assert one(spark, "<style>a<script>b</style>c</script>d", H.clean) == "a d"


def test_a_blank_before_an_odd_line_end_stays(spark):
    assert one(spark, "a \u2028", H.clean) == "a \u2028"
