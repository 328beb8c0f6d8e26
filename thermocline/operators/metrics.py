"""Latency, storage, hit-rate and result-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermocline.functions import tiers as rules
from thermocline.operators.order_stats import (
    interpolate,
    lower_rank,
    nearest_rank,
    order_statistics,
    upper_rank,
)

# Fixed values of the storage estimate: bytes per component, index overhead of
# the warm and cold stores, per-vector header of the hot store.
COMPONENT_BYTES = 4
STORE_OVERHEAD = 1.2
HOT_HEADER_BYTES = 152
GIB = 1024.0**3


def _moments(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count("latency_ms").alias("n"), F.avg("latency_ms").alias("mean"),
        F.min("latency_ms").alias("min"), F.max("latency_ms").alias("max"),
    )


def _median_ranks() -> dict:
    return {"m_low": lower_rank(0.5), "m_high": upper_rank(0.5)}


def _median() -> Column:
    return ((F.col("m_low") + F.col("m_high")) / 2).alias("median")


def latency_stats_nearest_rank(log: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, median, min, max and the values at rank floor(n * p) per group."""
    ranks = {**_median_ranks(), "p95": nearest_rank(0.95), "p99": nearest_rank(0.99)}
    order = order_statistics(log, keys, "latency_ms", ranks).select(*keys, _median(), "p95", "p99")
    return _moments(log, keys).join(order, keys)


def latency_stats_linear(log: DataFrame, keys: list[str]) -> DataFrame:
    """The same with linearly interpolated percentiles."""
    ranks = _median_ranks()
    for name, p in (("p95", 0.95), ("p99", 0.99)):
        ranks[f"{name}_low"], ranks[f"{name}_high"] = lower_rank(p), upper_rank(p)
    order = order_statistics(log, keys, "latency_ms", ranks).select(
        *keys, _median(),
        *[interpolate(F.col("n"), p, F.col(f"{name}_low"), F.col(f"{name}_high")).alias(name)
          for name, p in (("p95", 0.95), ("p99", 0.99))],
    )
    return _moments(log, keys).join(order, keys)


def _guarded(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom * 100.0).otherwise(F.lit(0.0))


def latency_compare(stats: DataFrame, baseline: str) -> DataFrame:
    """Every other system against the baseline, matched by threshold; both sides must be there.

    ``stats`` has one row per (system, threshold) as the stats functions give it.
    """
    measures = ("mean", "median", "p95", "p99")
    level = W.partitionBy("threshold")  # one row per system
    sides = stats.select(
        "threshold", "system", *[F.col(m).alias(f"tiered_{m}") for m in measures],
        *[F.max(F.when(F.col("system") == baseline, F.col(m))).over(level).alias(f"baseline_{m}") for m in measures],
    ).where((F.col("system") != baseline) & F.col("baseline_mean").isNotNull())
    b, t = F.col("baseline_mean"), F.col("tiered_mean")
    return sides.select(
        "threshold", "system", *[f"{side}_{m}" for side in ("baseline", "tiered") for m in measures],
        _guarded(b, t).alias("retention_pct"), (t - b).alias("mean_diff"), _guarded(t - b, b).alias("mean_diff_pct"),
        (F.col("tiered_p95") - F.col("baseline_p95")).alias("p95_diff"),
        _guarded(F.col("tiered_p95") - F.col("baseline_p95"), F.col("baseline_p95")).alias("p95_diff_pct"),
        _guarded(b - t, b).alias("improvement_pct"),
    )


def storage_report(tiers: DataFrame, hot_header: int = HOT_HEADER_BYTES) -> DataFrame:
    """Estimated size of the tiered layout against one store holding everything.

    ``tiers(tier, dim)``: one row per stored document. One output row per
    baseline type: ``local`` compares the warm tier, ``cloud`` the cold tier.
    """
    in_tier = lambda tier: F.col("tier") == tier
    component_sum = lambda condition: F.coalesce(
        F.sum(F.when(condition, F.col("dim").cast("bigint"))), F.lit(0)
    ).cast("double")
    number = lambda tier: F.count(F.when(in_tier(tier), 1))
    sums = tiers.agg(
        *[number(t).alias(f"n_tier{t}") for t in (1, 2, 3)],
        component_sum(F.lit(True)).alias("all_components"),
        *[component_sum(in_tier(t)).alias(f"components{t}") for t in (1, 2, 3)],
    )
    stored = lambda column: F.col(column) * COMPONENT_BYTES * F.lit(STORE_OVERHEAD) / F.lit(GIB)
    sizes = sums.select(
        "n_tier1", "n_tier2", "n_tier3", stored("all_components").alias("baseline_gb"),
        ((F.col("components1") * COMPONENT_BYTES + F.col("n_tier1") * hot_header) / F.lit(GIB)).alias("tier1_gb"),
        stored("components2").alias("tier2_gb"), stored("components3").alias("tier3_gb"),
    )
    kinds = F.explode(F.array(F.lit("local"), F.lit("cloud")))
    local = F.col("baseline_type") == "local"
    compared = F.when(local, F.col("tier2_gb")).otherwise(F.col("tier3_gb"))
    return sizes.withColumn("baseline_type", kinds).select(
        "baseline_type", "baseline_gb", "tier1_gb", "tier2_gb", "tier3_gb", "n_tier1", "n_tier2", "n_tier3",
        (F.col("baseline_gb") - compared).alias("saved_gb"),
        _guarded(F.col("baseline_gb") - compared, F.col("baseline_gb")).alias("saved_pct"),
        F.when(local, F.col("tier3_gb")).otherwise(F.col("tier2_gb")).alias("added_gb"),
    )


def tier_hit_counts(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hits per tier as columns, from the source label of each hit, and their average score."""
    bucket = rules.tier_of_label(F.col("source"))
    return hits.withColumn("_bucket", bucket).groupBy(*(keys or [])).agg(
        *[F.count(F.when(F.col("_bucket") == t, 1)).alias(f"t{t}_hits") for t in (1, 2, 3)],
        F.avg("score").alias("avg_similarity"),
    )


def _all_hits() -> Column:
    return F.col("t1_hits") + F.col("t2_hits") + F.col("t3_hits")


def tier_hit_rates(hits: DataFrame) -> DataFrame:
    """One row for each of the three tiers: hits and share of all hits."""
    counts = tier_hit_counts(hits)
    rows = F.inline(F.array(*[
        F.struct(F.lit(t).alias("tier"), F.col(f"t{t}_hits").alias("hits"), _all_hits().alias("total"))
        for t in (1, 2, 3)
    ]))
    return counts.select(rows).select("tier", "hits", _guarded(F.col("hits"), F.col("total")).alias("hit_pct"))


def result_quality(queries: DataFrame, hits: DataFrame, sample_n: int | None = None) -> DataFrame:
    """Average results per query (queries without any count) and average similarity of the results.

    ``sample_n`` restricts the report to the first queries; by default all count.
    """
    asked = queries.select("query_id")
    if sample_n is not None:
        asked = asked.orderBy("query_id").limit(sample_n)
    per_query = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    totals = asked.join(per_query, "query_id", "left").agg(
        F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_results"),
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("total_score"),
    )
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    return totals.select(
        "n_queries", "n_results",
        ratio(F.col("n_results"), F.col("n_queries")).alias("avg_results"),
        ratio(F.col("total_score"), F.col("n_results")).alias("avg_similarity"),
    )


def threshold_report(hits: DataFrame, n_queries: int, stats: DataFrame, thresholds: list[float],
                     baseline: str, tiered: str) -> DataFrame:
    """One row per threshold: latencies of both systems, retention, hits, result quality and tier shares.

    ``hits`` is a cascade sweep (with ``threshold``); ``stats`` has one row per
    (system, threshold). Thresholds without hits stay, with zeros.
    """
    counts = tier_hit_counts(hits, ["threshold"])
    levels = hits.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    compared = latency_compare(stats, baseline).where(F.col("system") == tiered).drop("system")
    zero = {"t1_hits": 0, "t2_hits": 0, "t3_hits": 0, "avg_similarity": 0.0}
    filled = levels.join(counts, "threshold", "left").fillna(zero).withColumn("total_hits", _all_hits())
    return filled.join(compared, "threshold", "left").select(
        "threshold", *[c for c in compared.columns if c.startswith(("baseline_", "tiered_"))], "retention_pct", "total_hits",
        (F.col("total_hits") / F.lit(max(n_queries, 1))).alias("avg_results"), "avg_similarity",
        *[_guarded(F.col(f"t{t}_hits"), F.col("total_hits")).alias(f"t{t}_pct") for t in (1, 2, 3)],
    )
