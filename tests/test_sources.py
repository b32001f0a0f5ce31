"""Concatenation, publishing and the body check on their edge cases."""

import pytest
from pyspark.sql import functions as F

from corvid import sources
from corvid.operators import browse


def test_parts_of_one_row_keep_their_own_places(spark):
    part = lambda *ids: spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "ord long, id string")
    got = sorted((r["ord"], r["id"]) for r in sources.corpus([part("a"), part(), part("b", "c"), part("d")]).collect())
    assert got == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_an_empty_table_is_not_published(spark, tmp_path):
    path = f"file://{tmp_path}/corpus"
    sources.publish(spark.range(3), path)
    with pytest.raises(ValueError, match="empty"):
        sources.publish(spark.range(0), path)
    assert sources.Snapshots(spark, path).read().count() == 3 and len([p for p in (tmp_path / "corpus").iterdir() if p.name.startswith("v-")]) == 1


def test_bodies_must_be_json_objects(spark):
    rows = [('{"q": 1}', 200), ("{not json}", 400), ("[1]", 400), (None, 400), (" {} ", 200), ('{"q": 1', 400)]
    df = spark.createDataFrame([(b, w, "x") for b, w in rows], "b string, w int, q string")
    assert all(r["s"] == r["w"] for r in df.withColumn("s", browse.http_status("b", "q")).collect())
    assert df.where(F.col("b").isNull()).count() == 1
