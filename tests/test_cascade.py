"""The cascade against a sequential model of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermocline.operators import retrieval, tier_table
from thermocline.session import scratch_path
from thermocline.operators.ann import ann_topk, build_cells
from tests.test_similarity import frame, unit


def model(tiers_of, docs, queries, k, threshold):
    """One query at a time: tier 1 filtered and sorted, then the ``remaining`` nearest of colder tiers."""
    sims = np.round(unit(docs) @ unit(queries).T, 9)
    out = []
    for q in range(len(queries)):
        if not np.any(queries[q]):
            continue
        found = []
        for tier in (1, 2, 3):
            remaining = k - len(found)
            if remaining <= 0:
                break
            nearest = sorted((d for d, t in tiers_of if t == tier), key=lambda d: (-sims[d, q], d))
            taken = {d for d, _ in found}
            asked = [d for d in nearest if sims[d, q] >= threshold] if tier == 1 else nearest[:remaining]
            fresh = [d for d in asked if d not in taken and sims[d, q] >= threshold]
            found += [(d, tier) for d in fresh[:remaining]]
        out += [(q, rank + 1, d, t) for rank, (d, t) in enumerate(found)]
    return set(out)


def tiered_frame(spark, docs, tiers_of):
    tiers = spark.createDataFrame(tiers_of, "doc_id bigint, tier int")
    return frame(spark, docs, "doc_id").join(tiers, "doc_id")


def result(df):
    return {(r["query_id"], r["rank"], r["doc_id"], r["tier"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("k,threshold", [(5, 0.2), (3, 0.6), (100, -0.5)])
def test_disjoint_tiers(spark, seed, k, threshold):
    rng = np.random.default_rng(seed)
    docs, queries = rng.normal(size=(40, 4)), rng.normal(size=(12, 4))
    queries[3] = 0
    tiers_of = [(d, int(t)) for d, t in enumerate(rng.choice([1, 2, 3], size=40, p=[0.1, 0.3, 0.6]))]
    tiered, asked = tiered_frame(spark, docs, tiers_of), frame(spark, queries, "query_id")
    want = model(tiers_of, docs, queries, k, threshold)
    assert result(retrieval.cascade_topk(tiered, asked, k, threshold)) == want
    assert result(retrieval.cascade_staged(tiered, asked, k, threshold)) == want


@pytest.mark.parametrize("seed", range(6))
def test_documents_in_two_tiers(spark, seed):
    rng = np.random.default_rng(100 + seed)
    docs, queries = rng.normal(size=(25, 3)), rng.normal(size=(10, 3))
    tiers_of = sorted({(int(d), int(t)) for d, t in zip(rng.integers(0, 25, 45), rng.integers(1, 4, 45))})
    tiered, asked = tiered_frame(spark, docs, tiers_of), frame(spark, queries, "query_id")
    assert result(retrieval.cascade_staged(tiered, asked, 4, 0.3)) == model(tiers_of, docs, queries, 4, 0.3)


def test_full_queries_do_not_read_colder_tiers(spark):
    docs = [[1.0, 0.0], [0.9, 0.1], [1.0, 0.05]]
    tiered = tiered_frame(spark, docs, [(0, 1), (1, 1), (2, 2)])
    hits = retrieval.cascade_staged(tiered, frame(spark, [[1.0, 0.0]], "query_id"), 2, 0.5)
    assert result(hits) == {(0, 1, 0, 1), (0, 2, 1, 1)}


def test_sweep_equals_single_runs_and_rising_threshold_adds_nothing(spark):
    rng = np.random.default_rng(5)
    docs, queries = rng.normal(size=(60, 4)), rng.normal(size=(9, 4))
    tiers_of = [(d, d % 3 + 1) for d in range(60)]
    tiered, asked = tiered_frame(spark, docs, tiers_of).cache(), frame(spark, queries, "query_id")
    sweep = retrieval.cascade_sweep(tiered, asked, 5, [0.2, 0.5, 0.9]).cache()
    sizes = []
    for threshold in (0.2, 0.5, 0.9):
        got = result(sweep.where(F.col("threshold") == threshold))
        assert got == model(tiers_of, docs, queries, 5, threshold)
        sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True)
    worst = sweep.groupBy("threshold", "query_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"))
    assert all(r["n"] <= 5 and r["n"] == r["d"] for r in worst.collect())


def test_query_without_results_keeps_its_row(spark):
    asked = frame(spark, [[1.0, 0.0], [0.0, 0.0]], "query_id")
    hits = retrieval.threshold_topk(frame(spark, [[0.0, 1.0]], "doc_id"), asked, 5, 0.5)
    rows = retrieval.results_per_query(asked, hits).collect()
    assert {(r["query_id"], r["n_results"], r["avg_score"]) for r in rows} == {(0, 0, None), (1, 0, None)}
    assert {r["query_id"]: r["is_zero"] for r in retrieval.zero_queries(asked).collect()} == {0: False, 1: True}


def test_enrich_keeps_hits_without_metadata_and_shortens_long_texts(spark):
    hits = spark.createDataFrame([(0, 1, 7), (0, 2, 8), (0, 3, 9)], "query_id bigint, rank int, doc_id bigint")
    meta = spark.createDataFrame([(7, "a", "x" * 200), (8, "b", "y" * 201)], "doc_id bigint, title string, text string")
    rows = {r["doc_id"]: r for r in retrieval.enrich(hits, meta).collect()}
    assert rows[7]["snippet"] == "x" * 200 and rows[8]["snippet"] == "y" * 200 + "..."
    assert rows[9]["title"] is None and rows[9]["doc_key"] == "doc9"


def test_sample_uses_fallback_labels(spark):
    asked = frame(spark, [[1.0, 0.0]] * 7, "query_id")
    hits = spark.createDataFrame(
        [(0, 2, 5, 0.5, "warm (T2)"), (0, 1, 4, 0.9, "hot (T1)"), (6, 1, 1, 0.3, "cold (T3)")],
        "query_id bigint, rank int, doc_id bigint, score double, source string",
    )
    texts = spark.createDataFrame([(1, "what?")], "query_id bigint, query_text string")
    rows = {r["query_id"]: r for r in retrieval.sample_results(asked, hits, texts, 3).collect()}
    assert set(rows) == {0, 1, 2}
    assert rows[0]["query_text"] == "Query 1" and rows[1]["query_text"] == "what?"
    assert [x["doc_id"] for x in rows[0]["results"]] == [4, 5] and rows[2]["results"] is None


def test_single_tier_baseline_ignores_threshold(spark):
    store = tier_table.single_tier(frame(spark, [[1.0, 0.0], [-1.0, 0.0]], "doc_id"), 3)
    hits = retrieval.baseline_topk(store, frame(spark, [[1.0, 0.0]], "query_id"), 5, threshold=0.99)
    assert [r["doc_id"] for r in sorted(hits.collect(), key=lambda r: r["rank"])] == [0, 1]


def test_cells_find_clustered_neighbours_and_all_cells_are_exact(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(10, 16))
    docs = np.repeat(middles, 40, axis=0) + 0.2 * rng.normal(size=(400, 16))
    queries = middles + 0.1 * rng.normal(size=(10, 16))
    doc_frame, asked = frame(spark, docs, "doc_id"), frame(spark, queries, "query_id")
    exact = {(r["query_id"], r["doc_id"]) for r in retrieval.threshold_topk(doc_frame, asked, 5, 0.5).collect()}
    index = build_cells(doc_frame, cells=10)
    near = {(r["query_id"], r["doc_id"]) for r in ann_topk(index, asked, 5, 0.5, probes=2).collect()}
    assert len(near & exact) / len(exact) >= 0.95
    every = ann_topk(index, asked, 5, 0.5, probes=10)
    assert {(r["query_id"], r["doc_id"]) for r in every.collect()} == exact


def test_hot_tier_in_memory_changes_no_result(spark):
    rng = np.random.default_rng(8)
    docs, queries = rng.normal(size=(50, 4)), rng.normal(size=(6, 4))
    tiered = tiered_frame(spark, docs, [(d, d % 3 + 1) for d in range(50)])
    path = scratch_path(spark, "tiers")
    tier_table.save_tiers(tiered, path)
    stored = tier_table.load_tiers(spark, path, tiered.schema)
    kept = tier_table.hot_in_memory(stored)
    asked = frame(spark, queries, "query_id")
    assert result(retrieval.cascade_staged(kept, asked, 4, 0.4)) == result(retrieval.cascade_topk(stored, asked, 4, 0.4))
    plan = kept.where(F.col("tier") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
