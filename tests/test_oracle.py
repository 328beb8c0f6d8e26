"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__
from tests.oracle_check import TESTDATA, connect, mismatch
from thermocline.plans import catalog, oracle

SF = str(TESTDATA / "sf0.001")
QUERIES = catalog.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_sql_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"ann_topk"}
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert mismatch(QUERIES[name](spark, SF), SQL[name], connection) is None


def test_approximate_search_recall(spark):
    exact = QUERIES["threshold_search"]  # same k and threshold, hot tier only
    assert exact(spark, SF).count() > 0
    from thermocline.operators import retrieval
    from thermocline.plans import bindings as b

    want = retrieval.threshold_topk(b.doc_vectors(spark, SF), b.held_out(spark, SF), b.K, b.THRESHOLD)
    want = {(r["query_id"], r["doc_id"]) for r in want.collect()}
    got = {(r["query_id"], r["doc_id"]) for r in QUERIES["ann_topk"](spark, SF).collect()}
    assert len(want & got) / len(want) >= 0.95


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
