"""The batch jobs a user runs on their own tables: tier build, evaluation, migration cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.functions import tiers as rules
from thermocline.operators import access, metrics, migration, retrieval
from thermocline.operators.tier_table import load_tiers, save_tiers
from thermocline.operators.tiering import (
    TierThresholds,
    assign_by_percentile,
    percentile_thresholds,
    temperatures,
)
from thermocline.session import materialize


@dataclass(frozen=True)
class TierBuild:
    """A finished tier build."""

    assignment: DataFrame  # doc_id, temperature, tier, tier1_threshold, tier2_threshold
    thresholds: TierThresholds
    tiered: DataFrame  # doc_id, temperature, dim, embedding, tier; stored partitioned by tier


def build_tiers(docs: DataFrame, workload: DataFrame, path: str,
                cuts: tuple[float, float] = rules.PERCENTILE_CUTS) -> TierBuild:
    """Temperatures of ``docs(doc_id, embedding)`` from ``workload(query_id, embedding)``,
    percentile tiers, and the tier table at ``path``.

    The vectors ride along with their temperature, so nothing is joined back
    and no vector is shuffled: one scan for the temperatures, one to lay the
    table out by tier.
    """
    warm = materialize(temperatures(docs, workload, keep_vectors=True), "temperatures")
    thresholds = percentile_thresholds(warm, cuts)
    assigned = assign_by_percentile(warm, thresholds)
    tiered = assigned.select("doc_id", "temperature", F.size("embedding").alias("dim"), "embedding", "tier")
    save_tiers(tiered, path)
    stored = load_tiers(docs.sparkSession, path, tiered.schema)
    return TierBuild(assigned.drop("embedding"), thresholds, stored)


def evaluate(tiered: DataFrame, queries: DataFrame, log: DataFrame, k: int, thresholds: list[float],
             baseline: str, tiered_system: str) -> DataFrame:
    """Threshold report: one cascade sweep over all queries next to the latency log
    ``(query_id, latency_ms, system, threshold)``."""
    hits = retrieval.cascade_sweep(tiered, queries, k, thresholds)
    stats = metrics.latency_stats_nearest_rank(log, ["system", "threshold"])
    return metrics.threshold_report(hits, queries.count(), stats, thresholds, baseline, tiered_system)


def migration_cycle(events: DataFrame, tiers: DataFrame, as_of: str, ts: Column,
                    cap: int | None) -> tuple[DataFrame, DataFrame]:
    """Access log to scores to one migration pass: (new tier map, log rows)."""
    scores = access.access_scores(access.access_stats(events, as_of), as_of)
    return migration.migration_pass(tiers, scores, ts, cap)
