import hashlib
import json

import pytest
from pyspark.sql import functions as F

from thermocline.functions import text
from thermocline.operators import tier_table, tiering
from thermocline.operators.tiering import TierThresholds
from thermocline.session import materialize, scratch_path, shared_root
from thermocline.sources import logs, queries, vectors


def test_store_requests_are_checked(spark):
    bodies = [
        '{"doc_id": 1, "embedding": [1, 2.5], "temperature": 0.95}',
        '{"doc_id": "2", "embedding": [1.0], "temperature": "0.7"}',
        '{"doc_id": 3, "embedding": [1.0]}',
        '{"doc_id": 4, "temperature": 1}',
        '{"embedding": [1.0], "temperature": 1}',
        '{"doc_id": 6, "embedding": "abc", "temperature": 1}',
        '{"doc_id": 7, "embedding": [1, null], "temperature": 1}',
        '{"doc_id": "x", "embedding": [1], "temperature": 1}',
        '{"doc_id": 9, "embedding": [1], "temperature": "warm"}',
        '{"doc_id": 10,',
        "{}",
        None,
        '{"doc_id": 12, "embedding": [], "temperature": 1}',
        '{"doc_id": 1.7, "embedding": [1], "temperature": 1}',
        '{"doc_id": 14, "embedding": [1, "NaN"], "temperature": 1}',
        '{"doc_id": 15, "embedding": [1], "temperature": "NaN"}',
    ]
    raw = spark.createDataFrame([(i, body) for i, body in enumerate(bodies)], "seq bigint, body string")
    parsed = vectors.parse_store_requests(raw).cache()
    reasons = [r["reason"] for r in parsed.orderBy("seq").collect()]
    assert reasons == [
        None, None, "missing temperature", "missing embedding", "missing doc_id", "bad embedding", "bad embedding",
        "bad doc_id", "bad temperature", "malformed", "missing doc_id", "malformed",
        "bad dimension", "bad doc_id", "not finite", "bad temperature",
    ]
    sized = vectors.parse_store_requests(raw, dimension=2).orderBy("seq").collect()
    assert [r["reason"] for r in sized[:2]] == [None, "bad dimension"]
    stored = {r["doc_id"]: (r["tier"], list(r["embedding"])) for r in vectors.accepted(parsed).collect()}
    assert stored == {1: (1, [1.0, 2.5]), 2: (2, [1.0])}
    assert vectors.rejected(parsed).count() == 14


def test_normalize_and_zero_vector(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    rows = {r["vec_id"]: [round(x, 6) for x in r["embedding"]] for r in vectors.normalize(df).collect()}
    assert rows == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_text_array_file(spark, tmp_path):
    texts = ["plain", "with \"quotes\"", "two\nlines", "é 😀", ""]
    (tmp_path / "texts.json").write_text(json.dumps(texts, indent=2))
    rows = queries.read_text_array(spark, str(tmp_path / "texts.json")).orderBy("query_id").collect()
    assert [r["query_text"] for r in rows] == texts and [r["query_id"] for r in rows] == list(range(5))


def test_query_text_objects_roundtrip(spark):
    path = scratch_path(spark, "texts")
    df = spark.createDataFrame([(1, "a\nb"), (2, 'c"d')], "query_id bigint, query_text string")
    queries.write_query_texts(df, path)
    assert sorted(map(tuple, queries.read_query_texts(spark, path).collect())) == sorted(map(tuple, df.collect()))


def test_logs_named_by_system_and_threshold(spark):
    root = scratch_path(spark, "logs")
    rows = [(1, 1.5, "baseline-cloud", 0.6), (2, 2.5, "tiered", 0.75), (3, 3.5, "tiered", 0.9)]
    df = spark.createDataFrame(rows, "query_id bigint, latency_ms double, system string, threshold double")
    logs.write_named_logs(df, root)
    assert sorted(map(tuple, logs.read_named_logs(spark, root).collect())) == rows
    path = scratch_path(spark, "log")
    logs.write_query_log(df, path, "tiered-th0.6")
    assert {r["system"] for r in logs.read_query_log(spark, path).collect()} == {"tiered-th0.6"}


def test_single_files_without_threshold_in_the_name(spark, tmp_path):
    (tmp_path / "query_log_tiered.csv").write_text("query_id,latency_ms,system\n0,1.25,tiered\n")
    (tmp_path / "query_log_tiered_th0.75.csv").write_text("query_id,latency_ms,system\n1,2.5,tiered-th0.75\n")
    rows = sorted(map(tuple, logs.read_named_logs(spark, str(tmp_path)).collect()))
    assert rows == [(0, 1.25, "tiered", None), (1, 2.5, "tiered", 0.75)]


def test_slice_and_incremental_selection(spark):
    ids = spark.range(10).withColumnRenamed("id", "query_id")
    assert [r["query_id"] for r in queries.query_slice(ids, 3, 4).orderBy("query_id").collect()] == [3, 4, 5, 6]
    assert queries.query_slice(ids, 8, 5).count() == 2
    for offset, count, want in ((3, 4, [3, 4, 5, 6]), (8, 5, [8, 9]), (10, 3, []), (0, 50, list(range(10)))):
        cut = queries.query_slice(ids, offset, count).orderBy("query_id").collect()
        assert [r["query_id"] for r in cut] == want
    repeated = spark.createDataFrame([(i,) for i in [None, None, 1, 1, 1, 1, 1, 1, 1, 2, 3, 3]], "query_id bigint")
    for offset, count in ((0, 1), (1, 4), (3, 5), (8, 10), (0, 100)):
        got = sorted((r["query_id"] is not None, r["query_id"] or 0) for r in queries.query_slice(repeated, offset, count).collect())
        want = [None, None, 1, 1, 1, 1, 1, 1, 1, 2, 3, 3][offset:offset + count]
        assert got == [(x is not None, x or 0) for x in want]
    assert queries.incremental_queries(repeated.where("query_id = 1"), repeated, 4).count() == 4
    existing = ids.where("query_id in (1, 4, 8)")
    pick = lambda wanted: {(r["query_id"], r["origin"]) for r in queries.incremental_queries(existing, ids, wanted).collect()}
    kept = {(1, "existing"), (4, "existing"), (8, "existing")}
    assert pick(5) == kept | {(0, "new"), (2, "new")}
    assert pick(100) == kept | {(i, "new") for i in (0, 2, 3, 5, 6, 7, 9)}
    assert pick(3) == kept and pick(2) == {(1, "existing"), (4, "existing")} and pick(0) == set()


def test_leakage_by_id_and_text(spark):
    schema = "query_id bigint, query_text string"
    work = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema)
    held = spark.createDataFrame([(3, "x"), (4, "a"), (5, "a"), (6, "c")], schema)
    both = work.withColumn("split", F.lit("workload")).unionByName(held.withColumn("split", F.lit("eval")))
    rows = {r["matched_by"]: (r["n_workload"], r["n_held_out"], r["leaked"]) for r in queries.query_leakage(both).collect()}
    assert rows == {"id": (3, 4, 1), "text": (3, 4, 2)}


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "query_id bigint, query_text string")
    fresh = lambda *pairs: queries.cache_entries(
        spark.createDataFrame(pairs, "query_text string, embedding array<float>"), "model-x"
    )
    cache = fresh(("a", [1.0, 2.0]))
    hits, misses = queries.cache_lookup(texts, cache)
    hit = hits.first()
    assert hit["query_md5"] == hashlib.md5(b"a").hexdigest() and (hit["n_queries"], hit["dimension"]) == (2, 2)
    assert {r["query_id"] for r in misses.collect()} == {3, 4}
    grown = queries.append_to_cache(cache, fresh(("a", [9.0, 9.0]), ("b", [3.0, 4.0]), ("c", [5.0, 6.0])))
    assert queries.cache_lookup(texts, grown)[1].isEmpty() and grown.count() == 3
    assert {tuple(r["embedding"]) for r in grown.where("query = 'a'").collect()} == {(1.0, 2.0)}


def test_keys_and_labels(spark):
    row = spark.createDataFrame([(12, None)], "id bigint, t string").select(
        text.doc_key(F.col("id")).alias("k"), text.doc_id_of_key(text.doc_key(F.col("id"))).alias("i"),
        text.query_label(F.col("t"), F.col("id")).alias("l"),
    ).first()
    assert tuple(row) == ("doc12", 12, "Query 13")


# -- tier table ----------------------------------------------------------------


def tiered(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, temperature double, seq bigint, tier int")


def test_tier_table_reads_one_partition_and_rebuilds_one_tier(spark):
    path = scratch_path(spark, "tiers")
    first = tiered(spark, [(1, 0.9, 0, 1), (2, 0.8, 0, 2), (3, 0.1, 0, 3)])
    tier_table.save_tiers(first, path)
    load = lambda tier=None: tier_table.load_tiers(spark, path, first.schema, tier)
    cold = load(3)
    assert [r["doc_id"] for r in cold.collect()] == [3]
    plan = cold._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tier" in plan
    tier_table.rebuild_tier(spark, path, tiered(spark, [(7, 0.2, 0, 2), (8, 0.2, 0, 3)]), 2)
    assert sorted((r["doc_id"], r["tier"]) for r in load().collect()) == [(1, 1), (3, 3), (7, 2)]


def test_upsert_keeps_copies_in_other_tiers(spark):
    before = tiered(spark, [(1, 0.9, 0, 1), (2, 0.8, 0, 2)])
    after = tier_table.upsert(before, tiered(spark, [(1, 0.1, 5, 3), (2, 0.75, 5, 2), (2, 0.76, 6, 2)]))
    assert sorted((r["doc_id"], r["tier"], r["seq"]) for r in after.collect()) == [(1, 1, 0), (1, 3, 5), (2, 2, 6)]
    plan = after._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # one row per task and key reaches the shuffle


def test_get_and_delete_by_id(spark):
    table = tiered(spark, [(1, 0.9, 0, 1), (1, 0.9, 0, 3), (2, 0.8, 0, 2)])
    ids = spark.createDataFrame([(1,), (1,), (9,)], "doc_id bigint")
    assert sorted(r["tier"] for r in tier_table.get_documents(table, ids).collect()) == [1, 3]
    assert [r["doc_id"] for r in tier_table.without_documents(table, ids).collect()] == [2]


def test_percentile_tiers(spark):
    temps = spark.range(101).select(F.col("id").alias("doc_id"), F.col("id").cast("double").alias("temperature"))
    cuts = tiering.percentile_thresholds(temps)
    assert cuts == TierThresholds(95.0, 75.0)
    counts = {r["tier"]: r["n_docs"] for r in tiering.tier_distribution(tiering.assign_by_percentile(temps, cuts)).collect()}
    assert counts == {1: 6, 2: 20, 3: 75}
    one = temps.where("doc_id = 4")
    assert tiering.percentile_thresholds(one) == TierThresholds(4.0, 4.0)


def test_scratch_lives_in_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_root(spark) == configured.rstrip("/")
    stored = materialize(spark.range(5), "numbers")
    assert stored.count() == 5 and shared_root(spark) in stored.inputFiles()[0]


def test_lifecycle_jobs_on_own_tables(spark):
    import numpy as np

    from thermocline.operators import retrieval
    from thermocline.plans import lifecycle
    from tests.test_similarity import frame, unit

    rng = np.random.default_rng(11)
    docs, work, held = rng.normal(size=(80, 6)), rng.normal(size=(30, 6)), rng.normal(size=(7, 6))
    build = lifecycle.build_tiers(frame(spark, docs, "doc_id"), frame(spark, work, "query_id"), scratch_path(spark, "own"))
    warm = np.maximum(unit(docs) @ unit(work).T, 0).sum(axis=1)
    assert build.thresholds.hot_at == pytest.approx(np.percentile(warm, 95), abs=1e-8)
    counts = {r["tier"]: r["n_docs"] for r in tiering.tier_distribution(build.tiered).collect()}
    assert counts == {1: 4, 2: 16, 3: 60}
    asked = frame(spark, held, "query_id")
    log = spark.createDataFrame(
        [(0, 8.0, "one store", 0.3), (0, 2.0, "tiers", 0.3)], "query_id bigint, latency_ms double, system string, threshold double"
    )
    report = lifecycle.evaluate(build.tiered, asked, log, 3, [0.3, 0.99], "one store", "tiers").collect()
    by = {r["threshold"]: r for r in report}
    assert by[0.3]["retention_pct"] == 400.0 and by[0.99]["total_hits"] == 0
    assert by[0.3]["total_hits"] == retrieval.cascade_topk(build.tiered, asked, 3, 0.3).count()


def test_stacked_logs_carry_their_system(spark):
    schema = "query_id bigint, latency_ms double"
    one, two = spark.createDataFrame([(0, 1.0)], schema), spark.createDataFrame([(0, 2.0), (1, 3.0)], schema)
    stacked = logs.stack_logs(baseline=one, tiered=two)
    rows = {(r["system"], r["query_id"], r["latency_ms"]) for r in stacked.collect()}
    assert rows == {("baseline", 0, 1.0), ("tiered", 0, 2.0), ("tiered", 1, 3.0)}


class _Fake:
    """A session without a configured checkpoint folder."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master, self.applicationId, self.folder = master, f"fake-{master}", None

    def get(self, key, default):
        return default

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(_Fake("spark://somewhere:7077"))
    local = _Fake("local[2]")
    assert shared_root(local) == local.folder == shared_root(local)
