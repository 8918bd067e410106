"""Every registered query: plan shape and, where SQL is given, equal results."""

import re

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
UNWANTED = ["PythonUDF", "EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    seen = []

    def query(session, folder):
        df = QUERIES[name](session, folder)
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    if name in ORACLE:
        assert compare(spark, FOLDER, con, query, ORACLE[name]) == []
    else:
        assert query(spark, FOLDER).count() >= 0
    assert [u for u in UNWANTED if u in seen[0]] == []


@pytest.mark.parametrize("name", ["content_change", "touch_unchanged", "fetch_outcome", "upsert_artifacts", "upsert_urls", "frontier_corpus", "top_domains"])
def test_raw_html_is_not_shuffled(spark, name):
    """Pages are hashed or read for links in the scan; their HTML is in no exchange and no aggregate."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if re.search(r"Exchange|Aggregate", line):
            assert not re.search(r"\bhtml#\d+", re.sub(r"sha2\(.*?256\)", "", line)), line


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(QUERIES)
