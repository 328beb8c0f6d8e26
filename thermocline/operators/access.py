"""Access counting and scoring. All functions take ``events(doc_id, ts)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.functions import tiers as rules


def moment(as_of: str, df: DataFrame, column: str) -> Column:
    """``as_of`` as a literal of the column's own timestamp type (never the wall clock)."""
    return F.lit(as_of).cast(df.schema[column].dataType)


def access_stats(events: DataFrame, as_of: str | None = None) -> DataFrame:
    """Count, first and last access per document; events after ``as_of`` have not happened yet."""
    if as_of is not None:
        events = events.where(F.col("ts") <= moment(as_of, events, "ts"))
    return events.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_accesses"), F.max("ts").alias("last_access"), F.min("ts").alias("first_access")
    )


def access_scores(stats: DataFrame, as_of: str) -> DataFrame:
    when = moment(as_of, stats, "last_access")
    return stats.withColumn("score", rules.access_score(F.col("total_accesses"), F.col("last_access"), when))


def access_records(docs: DataFrame, stats: DataFrame, as_of: str) -> DataFrame:
    """Total, last access and score for any document; one never accessed has 0, null and 0.0."""
    scored = access_scores(stats, as_of).select("doc_id", "total_accesses", "last_access", "score")
    return docs.select("doc_id").join(scored, "doc_id", "left").select(
        "doc_id", F.coalesce("total_accesses", F.lit(0).cast("bigint")).alias("total_accesses"), "last_access",
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def top_accessed(scored: DataFrame, n: int = 10) -> DataFrame:
    """Best scores first; equal scores in order of first access."""
    return scored.orderBy(F.desc("score"), "first_access", "doc_id").limit(n)
