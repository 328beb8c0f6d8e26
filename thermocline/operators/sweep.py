"""The quality of the cascade at every threshold, from one similarity pass.

A query's result changes only where the threshold passes the score of one of
its candidates, and its best k of each tier are all the candidates there are: at most 3 k break points a
query. What changes there (hits, similarity, hits per tier) is summed over the queries per break point; running sums from the highest
threshold down, over sorted ranges, give the report at every threshold, between break points too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermocline.functions import tiers as rules
from thermocline.functions.vectors import SCORE_DIGITS
from thermocline.operators.retrieval import tier_candidates
from thermocline.operators.similarity import Layout
from thermocline.session import materialize

MEASURES = ("hits", "similarity", "t1", "t2", "t3")


def _measured(chosen: Column) -> Column:
    """Hits, summed similarity and hits per tier of one result list."""
    of_tier = lambda tier: F.size(F.filter(chosen, lambda h: h["tier"] == tier)).cast("bigint")
    similarity = F.aggregate(chosen, F.lit(0.0), lambda s, h: s - h["minus"])
    return F.struct(
        F.size(chosen).cast("bigint").alias("hits"), similarity.alias("similarity"),
        *[of_tier(t).alias(f"t{t}") for t in (rules.HOT, rules.WARM, rules.COLD)])


def changes(candidates: DataFrame, k: int) -> DataFrame:
    """``(threshold, *MEASURES)``: what each break point adds to the totals of all queries."""
    by_score = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "tier", "doc_id")))
    lists = candidates.groupBy("query_id").agg(by_score.alias("c"))  # at most 3 k each

    def result(n: Column) -> Column:
        """The result when the first ``n`` candidates reach the threshold: hotter tiers first, then by score."""
        reached = F.transform(F.slice("c", F.lit(1), n), lambda h: F.struct(
            h["tier"].alias("tier"), h["minus"].alias("minus"), h["doc_id"].alias("doc_id")))
        return F.slice(F.array_sort(reached), 1, k)

    steps = F.transform(F.sequence(F.lit(1), F.size("c")), lambda i: F.struct(
        (-F.element_at("c", i)["minus"]).alias("threshold"), _measured(result(i)).alias("after"), _measured(result(i - 1)).alias("before")))
    rows = lists.select(F.explode(steps).alias("s"))
    added = [F.sum(F.col(f"s.after.{m}") - F.col(f"s.before.{m}")).alias(m) for m in MEASURES]
    return rows.groupBy(F.col("s.threshold").alias("threshold")).agg(*added)


def running(rows: DataFrame) -> DataFrame:
    """Totals at every break point: sums over all higher ones, without a window over the whole."""
    cut = materialize(
        rows.repartitionByRange(F.desc("threshold")).withColumn("_part", F.spark_partition_id()), "break-points")
    # one row per partition
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy("_part").agg(*[F.sum(m).alias(f"_{m}") for m in MEASURES])
    before = totals.select("_part", *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}") for m in MEASURES])
    inside = W.partitionBy("_part").orderBy(F.desc("threshold"))
    return cut.join(F.broadcast(before), "_part").select(
        "threshold", *[(F.sum(m).over(inside) + F.col(f"_{m}")).alias(m) for m in MEASURES])


def _report(totals: DataFrame, n_queries: int) -> DataFrame:
    share = lambda m: F.when(F.col("hits") > 0, F.col(m) * 100.0 / F.col("hits")).otherwise(0.0)
    return totals.select(
        "threshold", F.col("hits").alias("total_hits"), (F.col("hits") / max(n_queries, 1)).alias("avg_results"),
        F.when(F.col("hits") > 0, F.col("similarity") / F.col("hits")).otherwise(0.0).alias("avg_similarity"),
        *[share(f"t{t}").alias(f"t{t}_pct") for t in (1, 2, 3)])


def quality_at_every_threshold(tiered: DataFrame, queries: DataFrame, k: int, lowest: float, layout: Layout = Layout()) -> DataFrame:
    """One row per threshold >= ``lowest`` at which any result changes; a row holds down to the next lower one."""
    candidates = tier_candidates(tiered, queries, k, lowest, layout=layout)
    return _report(running(changes(candidates, k)), queries.count())


def quality_at(points: DataFrame, thresholds: list[float]) -> DataFrame:
    """The report at given thresholds, looked up among the break points of ``quality_at_every_threshold``."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("level")
    places = points.select(levels, F.struct("threshold", *[c for c in points.columns if c != "threshold"]).alias("p"))
    found = places.where(F.col("p.threshold") >= F.round("level", SCORE_DIGITS)).groupBy("level").agg(F.min_by("p", "p.threshold").alias("p"))
    return found.select(F.col("level").alias("threshold"), *[f"p.{c}" for c in points.columns if c != "threshold"])
