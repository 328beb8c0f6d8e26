"""Threshold search, baseline top-k and the cascaded top-k over tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermocline.functions import text, tiers
from thermocline.functions.vectors import distance_of_score
from thermocline.operators.similarity import Layout, similarity_hits
from thermocline.session import materialize

_BEST_FIRST = ("-score", "doc_id")


def _ranked(hits: DataFrame, keys: list[str], order: tuple[str, ...], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key; a leading minus sorts a column downwards."""
    columns = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*columns))
    return hits.withColumn(name, rank).where(F.col(name) <= k)


def best_first(hits: DataFrame, k: int) -> DataFrame:
    """Best k hits per query by score, ties by document id."""
    return _ranked(hits, ["query_id"], _BEST_FIRST, k)


def similar_pairs(docs: DataFrame, queries: DataFrame, threshold: float, layout: Layout = Layout()) -> DataFrame:
    """All (query, document) pairs with score >= threshold, with their cosine distance."""
    hits = similarity_hits(docs.select("doc_id", "embedding"), queries, threshold, layout=layout)
    return hits.select("query_id", "doc_id", "score", distance_of_score(F.col("score")).alias("distance"))


def baseline_topk(docs: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, layout: Layout = Layout()) -> DataFrame:
    """Plain top-k over one store. ``threshold`` is accepted and has no effect: the baseline never filters."""
    hits = similarity_hits(docs.select("doc_id", "embedding"), queries, None, k, layout=layout)
    return best_first(hits.drop("tier"), k)


def threshold_topk(docs: DataFrame, queries: DataFrame, k: int, threshold: float, layout: Layout = Layout()) -> DataFrame:
    """Best k documents of one tier among those with score >= threshold."""
    hits = similarity_hits(docs.select("doc_id", "embedding"), queries, threshold, k, layout)
    return best_first(hits.drop("tier"), k)


def tier_candidates(tiered: DataFrame, queries: DataFrame, k: int, threshold: float, layout: Layout = Layout()) -> DataFrame:
    """Best k hits per (query, tier) with score >= threshold; small, and enough for every cascade above it."""
    hits = similarity_hits(tiered.select("doc_id", "tier", "embedding"), queries, threshold, k, layout=layout)
    return _ranked(hits, ["query_id", "tier"], _BEST_FIRST, k, "tier_rank")


def cascade(candidates: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Hotter tiers first, then by score: the first k candidates per query."""
    ranked = _ranked(candidates, list(keys), ("tier", *_BEST_FIRST), k)
    return ranked.withColumn("source", tiers.source_label(F.col("tier"))).drop("tier_rank")


def cascade_topk(tiered: DataFrame, queries: DataFrame, k: int, threshold: float, layout: Layout = Layout()) -> DataFrame:
    """Cascaded top-k in one pass, for tiers that do not share documents.

    ``(query_id, rank, doc_id, score, tier, source)``
    """
    hits = similarity_hits(tiered.select("doc_id", "tier", "embedding"), queries, threshold, k, layout=layout)
    return cascade(hits, k)


def cascade_sweep(tiered: DataFrame, queries: DataFrame, k: int, thresholds: list[float], layout: Layout = Layout()) -> DataFrame:
    """The cascade for several thresholds from one similarity pass; adds ``threshold``.

    A tier's hits are sorted by score, so its best k at the lowest threshold
    contain its best k at every higher one.
    """
    candidates = tier_candidates(tiered, queries, k, min(thresholds), layout=layout)
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    spread = candidates.withColumn("threshold", levels).where(F.col("score") >= F.col("threshold"))
    return cascade(spread, k, ("threshold", "query_id"))


def cascade_staged(tiered: DataFrame, queries: DataFrame, k: int, threshold: float, layout: Layout = Layout()) -> DataFrame:
    """Cascaded top-k tier by tier, for tiers that may share documents.

    Each stage reads only its tier's partition and only asks for queries that
    are still short of k; with none left the tier is not read. A colder tier
    returns its ``remaining`` nearest before repeats are dropped, and dropped
    repeats are not refilled.
    """
    search = lambda tier, asked: threshold_topk(tiered.where(F.col("tier") == tier), asked, k, threshold, layout)
    return staged(queries, k, search)


def staged(queries: DataFrame, k: int, search: Callable[[int, DataFrame], DataFrame]) -> DataFrame:
    """The cascade over any per-tier search.

    ``search(tier, asked)`` returns the best k hits ``(query_id, rank, doc_id, score)`` of a tier for
    ``asked(query_id, embedding, remaining)``.
    """
    asked = queries.select("query_id", "embedding").withColumn("remaining", F.lit(k))
    found: DataFrame | None = None
    for tier in (tiers.HOT, tiers.WARM, tiers.COLD):
        if found is not None:
            taken = found.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("taken"))
            still_open = asked.join(taken, "query_id", "left").select(
                "query_id", "embedding", (F.col("remaining") - F.coalesce("taken", F.lit(0))).alias("remaining")
            ).where(F.col("remaining") > 0)
            still_open = materialize(still_open, "open-queries")  # measured as they are, read twice
        else:
            still_open = asked
        stage = search(tier, still_open)
        if found is not None:
            stage = (
                stage.join(still_open.select("query_id", "remaining"), "query_id")
                .where(F.col("rank") <= F.col("remaining"))
                .join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
            )
        stage = stage.select("query_id", F.lit(tier).alias("tier"), "doc_id", "score")
        stage = materialize(stage, f"cascade-tier{tier}")  # at most k rows per query; later stages start from here
        found = stage if found is None else found.unionByName(stage)
    return cascade(found, k)


def zero_queries(queries: DataFrame) -> DataFrame:
    """Queries with a flag for the zero vector, which has no direction and so no result."""
    return queries.withColumn("is_zero", ~F.exists("embedding", lambda x: x != 0))


def results_per_query(queries: DataFrame, hits: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Result count and mean score for every query, including those with none."""
    per_query = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_results"), F.avg("score").alias("avg_score"))
    return queries.select(*keys).join(per_query, list(keys), "left").withColumn(
        "n_results", F.coalesce("n_results", F.lit(0).cast("bigint"))
    )


def enrich(hits: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """Title and snippet next to each hit; hits without metadata stay."""
    meta = doc_meta.select("doc_id", "title", text.snippet(F.col("text")).alias("snippet"))
    return hits.join(meta, "doc_id", "left").withColumn("doc_key", text.doc_key(F.col("doc_id")))


def sample_results(queries: DataFrame, hits: DataFrame, query_text: DataFrame, n: int = 5) -> DataFrame:
    """The first n queries with their text and their hits as one sorted array (at most k entries each)."""
    sample = queries.select("query_id").orderBy("query_id").limit(n)
    nested = (
        hits.join(sample, "query_id", "left_semi")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score", "source"))).alias("results"))
    )
    texts = query_text.join(sample, "query_id", "left_semi")
    return (
        sample.join(nested, "query_id", "left").join(texts, "query_id", "left")
        .select("query_id", text.query_label(F.col("query_text"), F.col("query_id")).alias("query_text"), "results")
    )
