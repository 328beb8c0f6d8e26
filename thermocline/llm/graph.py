"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thermocline.llm.common import discard, store


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every higher neighbour of a node on the lowest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its lower neighbours on the lowest of them; every ``u`` is over its ``v``."""
    lowest = _lowest(edges)
    hung = edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, of nodes in ``links`` (columns a, b).

    Alternating large and small stars: each round is a few aggregations and
    joins, the edges never outnumber the links, and rounds grow with the logarithm of the
    longest chain. Each round is stored; it ends when nothing changes.
    Self links give a node no row; repeated links count once.
    """
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "edges")
    state = None
    while True:
        following = store(_small_star(_large_star(edges)), "edges")
        found = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = following
        if found == state:
            break
        state = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
