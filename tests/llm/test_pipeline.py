"""The pipeline's stages against plain versions, and the llm queries against their oracles."""

from collections import Counter

import pytest

import corpus_pipeline
from corvid.llm import mixing, queries

from .. import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    assert oracle.matches(queries.QUERIES[name](spark, SMALL).toPandas(), queries.ORACLES[name], SMALL)


def test_every_stage(spark, tmp_path):
    import duckdb

    from .test_operators import plain_components, plain_spans

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120)
    rows, columns, out = docs.collect(), docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    language, unique, clean, mixed, packed = out
    assert len(language) >= 0.95 * len(rows) and {r["doc_id"] for r in language} <= {r["doc_id"] for r in rows}
    first = {i for i, _, c in plain_components([(r["doc_id"], r["text"]) for r in language], 5, 80) if i == c}
    assert {str(r["doc_id"]) for r in unique} == first
    before = {r["doc_id"]: r["text"] for r in unique}
    for r in clean:
        assert plain_spans(r["text"]) == [] and (r["text"] == before[r["doc_id"]] or "<" in r["text"])
    con = duckdb.connect()
    con.sql(f"create view d as select * from read_parquet('{tmp_path}/2/*.parquet')")
    want = con.sql(mixing.ORACLE.format(docs="d")).df()
    want = {int(i): round(t / s) for i, s, t in zip(want.doc_id, want["size"], want.taken, strict=True) if s and t}
    got = Counter(r["doc_id"] for r in mixed if len(r["text"].split()))
    assert got == want
    pieces = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert pieces == Counter(r["doc_id"] for r in mixed)
    held = Counter()
    for r in packed:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 1024


def test_run_returns_packed_pieces(spark):
    x = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "ids", "sequence_id", "offset"} <= set(x.columns) and x.count() > 0
