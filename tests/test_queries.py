import os

import pytest

from corvid.plans import queries

from . import oracle

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    assert oracle.matches(queries.QUERIES[name](spark, SMALL).toPandas(), queries.ORACLES[name], SMALL)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_no_python_rows_on_the_retrieval_path(spark):
    plan = queries.QUERIES["lexical_topk"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
