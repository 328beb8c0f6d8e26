"""Tier rules, labels and the access score as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOT, WARM, COLD = 1, 2, 3

# Cut-offs of the two absolute tier rules, access-score scales,
# the migration cap and the labels written next to a hit.
TEMPERATURE_CUTS = (0.9, 0.7)
ACCESS_CUTS = (0.7, 0.3)
PERCENTILE_CUTS = (0.95, 0.75)
FULL_FREQUENCY = 100.0
RECENCY_HOURS = 24.0
MIGRATION_CAP = 20
SOURCE_LABELS = ("hot (T1)", "warm (T2)", "cold (T3)")
LABEL_WORDS = {1: ("T1", "redis"), 2: ("T2", "local"), 3: ("T3", "remote")}


def by_cuts(value: Column, hot_at: float | Column, warm_at: float | Column) -> Column:
    """Tier 1 at or above ``hot_at``, tier 2 at or above ``warm_at``, else tier 3; what is no number is cold."""
    hot_at = hot_at if isinstance(hot_at, Column) else F.lit(float(hot_at))
    warm_at = warm_at if isinstance(warm_at, Column) else F.lit(float(warm_at))
    number = ~F.isnan(value.cast("double"))
    return F.when(number & (value >= hot_at), F.lit(HOT)).when(number & (value >= warm_at), F.lit(WARM)).otherwise(F.lit(COLD))


def by_temperature(temperature: Column, cuts: tuple[float, float] = TEMPERATURE_CUTS) -> Column:
    """Tier of a document whose temperature is a value between 0 and 1."""
    return by_cuts(temperature, *cuts)


def by_access_score(score: Column, cuts: tuple[float, float] = ACCESS_CUTS) -> Column:
    return by_cuts(score, *cuts)


def source_label(tier: Column) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label in SOURCE_LABELS]), tier)


def tier_of_label(label: Column) -> Column:
    """Tier bucket of a source label; the hot test comes first, unknown labels give null."""
    bucket = F.lit(None).cast("int")
    for tier in (COLD, WARM, HOT):
        mark, word = LABEL_WORDS[tier]
        hit = label.contains(mark) | F.lower(label).contains(word)
        bucket = F.when(hit, F.lit(tier)).otherwise(bucket)
    return bucket


def access_score(total: Column, last_access: Column, as_of: Column) -> Column:
    """Half frequency (capped at 1), half recency (fading to 0 over a day); unknown documents score 0."""
    hours = F.timestamp_diff("MICROSECOND", last_access, as_of) / F.lit(3600.0 * 1e6)
    frequency = F.least(F.lit(1.0), total / F.lit(FULL_FREQUENCY))
    recency = F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - hours / F.lit(RECENCY_HOURS)), F.lit(0.0))
    return F.when(total > 0, (frequency + recency) / F.lit(2.0)).otherwise(F.lit(0.0))
