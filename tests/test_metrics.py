import numpy as np
import pytest

from thermocline.operators import metrics


def log(spark, rows):
    return spark.createDataFrame(rows, "threshold double, system string, latency_ms double")


def test_both_percentile_definitions(spark):
    values = [float(x) for x in range(1, 101)]
    df = log(spark, [(0.5, "a", x) for x in values] + [(0.5, "b", 4.0)])
    near = {r["system"]: r for r in metrics.latency_stats_nearest_rank(df, ["system"]).collect()}
    line = {r["system"]: r for r in metrics.latency_stats_linear(df, ["system"]).collect()}
    assert (near["a"]["p95"], near["a"]["p99"]) == (96.0, 100.0)
    assert line["a"]["p95"] == pytest.approx(np.percentile(values, 95))
    for stats in (near, line):
        assert (stats["a"]["n"], stats["a"]["mean"], stats["a"]["median"]) == (100, 50.5, 50.5)
        assert (stats["b"]["min"], stats["b"]["max"], stats["b"]["p95"], stats["b"]["median"]) == (4.0, 4.0, 4.0, 4.0)
    assert metrics.latency_stats_nearest_rank(df.where("false"), ["system"]).count() == 0


def test_comparison_needs_both_sides_and_guards_zero(spark):
    df = log(spark, [(0.5, "base", 10.0), (0.5, "fast", 4.0), (0.5, "idle", 0.0), (0.9, "fast", 4.0)])
    stats = metrics.latency_stats_nearest_rank(df, ["system", "threshold"])
    rows = {(r["threshold"], r["system"]): r for r in metrics.latency_compare(stats, "base").collect()}
    assert set(rows) == {(0.5, "fast"), (0.5, "idle")}
    fast = rows[(0.5, "fast")]
    assert (fast["retention_pct"], fast["mean_diff"], fast["mean_diff_pct"], fast["improvement_pct"]) == (250.0, -6.0, -60.0, 60.0)
    assert rows[(0.5, "idle")]["retention_pct"] == 0.0


def test_storage_of_the_published_split(spark):
    """500 / 2,000 / 7,500 documents of 768 components: published 0.0343, 0.0015, 0.0069, 0.0257 GB and 25 %."""
    tiers = spark.sql(
        "SELECT CASE WHEN id < 500 THEN 1 WHEN id < 2500 THEN 2 ELSE 3 END AS tier, 768 AS dim FROM range(10000)"
    )
    rows = {r["baseline_type"]: r for r in metrics.storage_report(tiers).collect()}
    cloud = rows["cloud"]
    published = [round(cloud[c], 4) for c in ("baseline_gb", "tier1_gb", "tier2_gb", "tier3_gb")]
    assert published == [0.0343, 0.0015, 0.0069, 0.0257]
    assert cloud["saved_pct"] == pytest.approx(25.0) and cloud["added_gb"] == cloud["tier2_gb"]
    assert rows["local"]["saved_pct"] == pytest.approx(80.0) and rows["local"]["added_gb"] == cloud["tier3_gb"]


def test_storage_of_nothing(spark):
    empty = spark.createDataFrame([], "tier int, dim int")
    assert {r["saved_pct"] for r in metrics.storage_report(empty).collect()} == {0.0}


HITS = "threshold double, query_id bigint, rank int, score double, source string"


def test_hit_rates_show_all_tiers(spark):
    hits = spark.createDataFrame([(0.5, 1, 1, 0.9, "hot (T1)"), (0.5, 1, 2, 0.8, "cold (T3)"), (0.5, 2, 1, 0.7, "hot (T1)")], HITS)
    rows = {r["tier"]: (r["hits"], round(r["hit_pct"], 4)) for r in metrics.tier_hit_rates(hits).collect()}
    assert rows == {1: (2, 66.6667), 2: (0, 0.0), 3: (1, 33.3333)}
    none = {r["tier"]: r["hit_pct"] for r in metrics.tier_hit_rates(hits.where("false")).collect()}
    assert none == {1: 0.0, 2: 0.0, 3: 0.0}


def test_quality_counts_queries_without_results(spark):
    asked = spark.createDataFrame([(i,) for i in range(4)], "query_id bigint")
    hits = spark.createDataFrame([(0.5, 0, 1, 0.9, "x"), (0.5, 0, 2, 0.7, "x"), (0.5, 3, 1, 0.5, "x")], HITS)
    row = metrics.result_quality(asked, hits).first()
    assert (row["n_queries"], row["n_results"], row["avg_results"]) == (4, 3, 0.75)
    assert row["avg_similarity"] == pytest.approx(0.7)
    assert metrics.result_quality(asked, hits, sample_n=2).first()["avg_results"] == 1.0
    assert metrics.result_quality(asked, hits.where("false")).first()["avg_similarity"] == 0.0


def test_report_keeps_thresholds_without_hits(spark):
    hits = spark.createDataFrame([(0.2, 0, 1, 0.9, "hot (T1)"), (0.2, 1, 1, 0.5, "warm (T2)")], HITS)
    stats = metrics.latency_stats_nearest_rank(
        log(spark, [(0.2, "b", 8.0), (0.2, "t", 2.0), (0.9, "b", 8.0), (0.9, "t", 16.0)]), ["system", "threshold"]
    )
    rows = {r["threshold"]: r for r in metrics.threshold_report(hits, 4, stats, [0.2, 0.9], "b", "t").collect()}
    assert (rows[0.2]["total_hits"], rows[0.2]["avg_results"], rows[0.2]["retention_pct"]) == (2, 0.5, 400.0)
    assert (rows[0.2]["t1_pct"], rows[0.2]["t2_pct"], rows[0.2]["t3_pct"]) == (50.0, 50.0, 0.0)
    assert (rows[0.9]["total_hits"], rows[0.9]["avg_similarity"], rows[0.9]["retention_pct"]) == (0, 0.0, 50.0)
