"""Steps whose rows Spark counts too low (after an explode or a Python function) never go through the driver."""

import numpy as np
import pytest

from thermocline.llm import ann, simhash
from thermocline.llm.common import store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def default_threshold(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"


def test_op1_broadcasts_no_table_of_fingerprints(spark, tmp_path):
    prints = store(spark.range(2000).selectExpr("xxhash64(id) AS fp").union(
        spark.range(3).selectExpr("xxhash64(5L) ^ shiftleft(1L, cast(7 + id AS int)) AS fp")), "test-prints")
    links = simhash.linked_fingerprints(prints)
    assert "Broadcast" not in plan_of(links) and "SortMergeJoin" in plan_of(links)
    assert len({frozenset(r) for r in links.collect()}) == 6

    texts = ["one two three four five", "one two three four five", "six seven eight nine ten", None]
    rows = [(i, text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = simhash.op1_simhash(spark, str(tmp_path))
    assert "Broadcast" not in plan_of(found)
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(0, 0), (1, 0), (2, 2), (3, 3)}


def test_op4_broadcasts_no_probes(spark, monkeypatch):
    plans = {}

    def stored(df, name):
        plans[name] = plan_of(df)
        return store(df, name)

    monkeypatch.setattr(ann, "store", stored)
    random = np.random.default_rng(8)
    rows = [(i, [float(x) for x in random.normal(size=8)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(table, table.where("vec_id % 100 = 0")).collect()
    assert "Broadcast" not in plans["candidates"] and "SortMergeJoin" in plans["candidates"]
    vectors = np.array([v for _, v in rows])
    for query in range(0, 400, 100):
        want = np.argsort(np.sqrt(((vectors - vectors[query]) ** 2).sum(axis=1)))[1:11]
        assert len({r["vec_id"] for r in found if r["query_id"] == query} & set(want.tolist())) >= 9
