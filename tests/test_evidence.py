import os

import pytest

from corvid import sources as S
from corvid.operators import evidence, retrieval
from corvid.plans import queries

from . import oracle
from .test_queries import SMALL
from .test_retrieval import LEX, OTHER, SECOND, ask


def test_pairs_of_queries_and_chunks_are_no_rows(spark, monkeypatch):
    plans, forms, write = {}, set(), S.Kept.__call__

    def seen(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        out = write(self, df, name)
        if name == "index":
            forms.update(f for r in out.select("tf").collect() for f in r["tf"])
        return out

    monkeypatch.setattr(S.Kept, "__call__", seen)
    assert ask(spark, [LEX, SECOND, OTHER], "قسوة القلب") == {(0, 1): "lex", (0, 2): "other", (0, 3): "second"}
    # there was a row for each pair and word in common, and texts kept all their words
    assert "Generate" not in plans["picked"]
    assert forms <= {"قسوة", "قسوه", "قلب", "القلب", "قس"}


def test_a_query_is_found_whole_by_its_rarest_word(spark):
    long = "داء يورث الغفلة ودواؤه مجالسة الصالحين"
    noise = [{**OTHER, "id": f"n{k}", "text": "داء يورث الغفلة " + "ودواؤه كثير في هذا الباب " * 3, "keywords": []} for k in range(3)]
    got = ask(spark, [*noise, {**LEX, "text": LEX["text"].replace("،", "")}], long)
    assert got[0, 1] == "lex"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_blocks_of_queries_and_texts_with_all_forms(spark, monkeypatch):
    monkeypatch.setattr(evidence, "BLOCK", 9000)
    monkeypatch.setattr(evidence, "CELLS", 700)
    monkeypatch.setattr(retrieval, "MOST_FORMS", 0)
    assert oracle.matches(queries.QUERIES["retrieved_passages"](spark, SMALL).toPandas(), queries.ORACLES["retrieved_passages"], SMALL)
