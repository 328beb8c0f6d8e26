import numpy as np
import pytest
from pyspark.sql import functions as F

from thermocline.operators import retrieval, similarity
from thermocline.operators.similarity import Layout, document_warmth, similarity_hits

ONE = Layout()
BLOCKS = Layout(block_bytes=600)
SMALL = Layout(block_bytes=100, chunk_bytes=300)
LAYOUTS = pytest.mark.parametrize("layout", [ONE, BLOCKS, SMALL], ids=["one", "blocks", "small"])


def frame(spark, matrix, key, first=0):
    rows = [(first + i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>").repartition(3)


def unit(matrix):
    matrix = np.asarray(matrix, dtype=np.float32).astype(float)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length > 0, length, 1)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    docs, queries = rng.normal(size=(60, 8)), rng.normal(size=(25, 8))
    docs[5] = 0
    docs[10] = docs[11] = docs[12] = docs[3]  # copies
    queries[4] = 0
    return docs, queries


@LAYOUTS
def test_warmth_matches_numpy(spark, vectors, layout):
    docs, queries = vectors
    sims = unit(docs) @ unit(queries).T
    rows = document_warmth(frame(spark, docs, "doc_id"), frame(spark, queries, "query_id"), profile=True, layout=layout).collect()
    assert len(rows) == 60
    for row in rows:
        mine = sims[row["doc_id"]]
        assert row["temperature"] == pytest.approx(np.maximum(mine, 0).sum(), abs=1e-9)
        assert row["sim_min"] == pytest.approx(mine.min(), abs=1e-8)
        assert row["sim_max"] == pytest.approx(mine.max(), abs=1e-8)
        assert row["n_queries"] == 25


@LAYOUTS
def test_vectors_ride_along(spark, vectors, layout):
    docs, queries = vectors
    rows = document_warmth(frame(spark, docs, "doc_id"), frame(spark, queries, "query_id"), True, layout=layout).collect()
    assert len(rows) == 60
    assert all(np.allclose(row["embedding"], docs[row["doc_id"]], atol=1e-6) for row in rows)


def test_no_workload_leaves_every_document_cold(spark, vectors):
    docs, _ = vectors
    none = spark.createDataFrame([], "query_id bigint, embedding array<float>")
    rows = document_warmth(frame(spark, docs, "doc_id"), none, profile=True).collect()
    assert len(rows) == 60
    assert {row["temperature"] for row in rows} == {0.0} and {row["sim_min"] for row in rows} == {None}


def brute_topk(docs, queries, k, floor):
    sims = np.round(unit(docs) @ unit(queries).T, 9)
    out = set()
    for q in range(len(queries)):
        if not np.any(queries[q]):
            continue
        order = sorted((d for d in range(len(docs)) if sims[d, q] >= floor), key=lambda d: (-sims[d, q], d))
        out |= {(q, rank + 1, d) for rank, d in enumerate(order[:k])}
    return out


@LAYOUTS
@pytest.mark.parametrize("k", [1, 4, 1000])
def test_topk_with_copies_and_zero_query(spark, vectors, layout, k):
    docs, queries = vectors
    hits = retrieval.baseline_topk(frame(spark, docs, "doc_id"), frame(spark, queries, "query_id"), k, layout=layout)
    got = {(r["query_id"], r["rank"], r["doc_id"]) for r in hits.collect()}
    assert got == brute_topk(docs, queries, k, -np.inf)


@LAYOUTS
def test_threshold_pairs(spark, vectors, layout):
    docs, queries = vectors
    pairs = retrieval.similar_pairs(frame(spark, docs, "doc_id"), frame(spark, queries, "query_id"), 0.3, layout)
    got = {(r["query_id"], r["doc_id"]) for r in pairs.collect()}
    assert got == {(q, d) for q, _, d in brute_topk(docs, queries, 10**6, 0.3)}


def test_threshold_is_inclusive(spark):
    docs = frame(spark, [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]], "doc_id")
    asked = frame(spark, [[5.0, 0.0]], "query_id")
    hits = retrieval.threshold_topk(docs, asked, 5, 0.6).collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in sorted(hits, key=lambda r: r["rank"])] == [(0, 1.0), (1, 0.6)]


def test_a_third_of_all_documents_are_copies(spark):
    rng = np.random.default_rng(1)
    docs = rng.normal(size=(9000, 6))
    docs[rng.permutation(9000)[:3000]] = docs[0]
    queries = np.vstack([docs[0], rng.normal(size=(3, 6))])
    hits = retrieval.baseline_topk(frame(spark, docs, "doc_id"), frame(spark, queries, "query_id"), 5)
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in hits.collect()} == brute_topk(docs, queries, 5, -np.inf)


def test_ragged_vectors_are_refused(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0])], "doc_id bigint, embedding array<float>")
    asked = frame(spark, [[1.0, 0.0]], "query_id")
    with pytest.raises(Exception, match="2 components"):
        similarity_hits(docs, asked, 0.0).collect()
    with pytest.raises(ValueError, match="of 2 and of 3"):
        similarity_hits(docs, docs.withColumnRenamed("doc_id", "query_id"), 0.0)


def test_plan_moves_only_candidates(spark, vectors):
    docs, queries = vectors
    tiered = frame(spark, docs, "doc_id").withColumn("tier", F.lit(1))
    plan = retrieval.cascade_topk(tiered, frame(spark, queries, "query_id"), 3, 0.1)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "CartesianProduct" not in physical and "NestedLoopJoin" not in physical
    assert "WindowGroupLimit" in physical
    assert physical.index("hashpartitioning(query_id") < physical.index("MapInArrow")


def test_column_expressions_agree_with_the_kernel(spark, vectors):
    docs, _ = vectors
    from thermocline.functions import vectors as fn

    df = frame(spark, docs, "vec_id")
    pairs = df.select(
        "vec_id", fn.dimension("embedding").alias("dim"), fn.norm("embedding").alias("norm"),
        fn.dot("embedding", "embedding").alias("dot"), fn.unit("embedding", fn.norm("embedding")).alias("unit"),
        fn.score_of_distance(fn.distance_of_score(F.lit(0.25))).alias("score"),
    ).collect()
    units = unit(docs)
    for row in pairs:
        mine = np.asarray(docs[row["vec_id"]], dtype=np.float32).astype(float)
        assert row["dim"] == 8 and row["score"] == 0.25
        assert row["dot"] == pytest.approx(mine @ mine) and row["norm"] == pytest.approx(np.linalg.norm(mine))
        assert np.allclose(row["unit"], units[row["vec_id"]], atol=1e-6)


@LAYOUTS
def test_repeated_ids_and_vectors_without_direction(spark, vectors, layout):
    """Rows are scored as rows; a component that is not finite costs no other row its hits."""
    docs, queries = vectors
    rows = [(i // 2, [float(x) for x in row]) for i, row in enumerate(docs)]
    bad = [(100, [float("nan")] * 8), (101, [float("inf")] + [1.0] * 7), (102, [float("nan")] + [1.0] * 7)]
    table = spark.createDataFrame(rows + bad, "doc_id bigint, embedding array<double>").repartition(3)
    asked = frame(spark, queries, "query_id").unionByName(
        spark.createDataFrame([(900, [float("nan")] * 8)], "query_id bigint, embedding array<float>"))
    warm = document_warmth(table, asked, layout=layout).where("doc_id < 100").collect()
    sims = unit(docs) @ unit(queries).T
    assert sorted(round(r["temperature"], 6) for r in warm) == sorted(round(float(x), 6) for x in np.maximum(sims, 0).sum(axis=1))
    hits = similarity_hits(table, asked, None, 2, layout).collect()
    assert {r["doc_id"] for r in hits}.isdisjoint({100, 101, 102}) and 900 not in {r["query_id"] for r in hits}
    best = {q: sorted(np.round(sims[:, q], 6))[-2:] for q in range(25) if np.any(queries[q])}
    got = {}
    for r in hits:
        got.setdefault(r["query_id"], []).append(round(r["score"], 6))
    assert {q: sorted(v)[-2:] for q, v in got.items()} == {q: list(map(float, v)) for q, v in best.items()}


@LAYOUTS
def test_documents_are_never_exchanged(spark, vectors, layout):
    docs, queries = vectors
    work = document_warmth(frame(spark, docs, "doc_id").coalesce(2), frame(spark, queries, "query_id"), True, layout=layout)
    physical = work._jdf.queryExecution().executedPlan().toString()
    assert physical.count("MapInArrow") == 1 and "Join" not in physical


def test_blocks_hold_no_more_queries_than_kept_hits_allow(spark, monkeypatch):
    """Before, only bytes cut query sets, so a task kept the hits of as many queries as 192 MB hold."""
    rng = np.random.default_rng(3)
    docs, asked = frame(spark, rng.normal(size=(50, 4)), "doc_id"), frame(spark, rng.normal(size=(40, 4)), "query_id")
    pick = lambda: sorted(tuple(r) for r in retrieval.threshold_topk(docs, asked, 3, 0.1).collect())
    want, sizes = pick(), []
    send = spark.sparkContext.broadcast
    monkeypatch.setattr(similarity, "KEPT_ROWS", 30)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda block: (sizes.append(len(block[0])), send(block))[1])
    assert pick() == want
    assert sum(sizes) == 40 and max(sizes) <= 10
