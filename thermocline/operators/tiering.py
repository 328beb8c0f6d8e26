"""Temperatures, percentile thresholds, tier assignment and its summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.functions import tiers as rules
from thermocline.operators.order_stats import interpolate, lower_rank, order_statistics, upper_rank
from thermocline.operators.similarity import Layout, document_warmth

TEMPERATURE_DIGITS = 9  # temperatures are rounded before they meet a threshold derived from them


def temperatures(docs: DataFrame, workload: DataFrame, keep_vectors: bool = False,
                 layout: Layout = Layout()) -> DataFrame:
    """``(doc_id, temperature[, embedding])``: sum of positive cosine similarities to the workload."""
    warmth = document_warmth(docs, workload, keep_vectors, layout=layout)
    kept = ["embedding"] if keep_vectors else []
    return warmth.select("doc_id", F.round("temperature", TEMPERATURE_DIGITS).alias("temperature"), *kept)


@dataclass(frozen=True)
class TierThresholds:
    hot_at: float
    warm_at: float


def percentile_thresholds(temps: DataFrame, cuts: tuple[float, float] = rules.PERCENTILE_CUTS) -> TierThresholds:
    """Linear-interpolation percentiles of the temperatures (two numbers reach the driver)."""
    ranks = {}
    for name, p in zip(("hot", "warm"), cuts):
        ranks[f"{name}_low"], ranks[f"{name}_high"] = lower_rank(p), upper_rank(p)
    stats = order_statistics(temps, [], "temperature", ranks)
    row = stats.select(*[
        interpolate(F.col("n"), p, F.col(f"{name}_low"), F.col(f"{name}_high")).alias(name)
        for name, p in zip(("hot", "warm"), cuts)
    ]).first()
    if row is None:
        return TierThresholds(float("inf"), float("inf"))
    return TierThresholds(row["hot"], row["warm"])


def assign_by_percentile(temps: DataFrame, thresholds: TierThresholds) -> DataFrame:
    """Adds ``tier`` and the two thresholds; ``temps`` should be a stored table, it is read again here."""
    return temps.select(
        "*",
        rules.by_cuts(F.col("temperature"), thresholds.hot_at, thresholds.warm_at).alias("tier"),
        F.lit(thresholds.hot_at).alias("tier1_threshold"),
        F.lit(thresholds.warm_at).alias("tier2_threshold"),
    )


def relative_temperatures(temps: DataFrame) -> DataFrame:
    """Temperatures scaled into 0..1 by their maximum, the input the absolute rule expects."""
    hottest = temps.agg(F.max("temperature")).first()[0] or 0.0
    scaled = F.col("temperature") / F.lit(hottest) if hottest > 0 else F.lit(0.0)
    return temps.withColumn("temperature", F.round(scaled, TEMPERATURE_DIGITS))


def assign_by_temperature(temps: DataFrame, cuts: tuple[float, float] = rules.TEMPERATURE_CUTS) -> DataFrame:
    return temps.withColumn("tier", rules.by_temperature(F.col("temperature"), cuts))


def assign_by_access_score(scores: DataFrame, cuts: tuple[float, float] = rules.ACCESS_CUTS) -> DataFrame:
    return scores.withColumn("tier", rules.by_access_score(F.col("score"), cuts))


def temperature_stats(temps: DataFrame) -> DataFrame:
    return temps.agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("temperature").alias("min_temperature"),
        F.max("temperature").alias("max_temperature"), F.avg("temperature").alias("mean_temperature"),
        F.stddev_pop("temperature").alias("std_temperature"),
    )


def tier_distribution(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n_docs"))
