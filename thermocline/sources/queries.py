"""Query sets: splits, slices, incremental selection, texts and the embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.functions import text
from thermocline.operators.order_stats import row_ranks

WORKLOAD, HELD_OUT = "workload", "eval"


def split_queries(vectors: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds ``split``: vectors whose id occurs in ``seen`` are the workload, the others are held out."""
    mark = seen.select("query_id").distinct().withColumn("_seen", F.lit(True))
    split = F.when(F.col("_seen"), WORKLOAD).otherwise(HELD_OUT)
    return vectors.join(mark, "query_id", "left").withColumn("split", split).drop("_seen")


def query_slice(queries: DataFrame, offset: int, count: int, by: str = "query_id") -> DataFrame:
    """Skip ``offset`` rows in the order of ``by`` (nulls first) and take at most ``count`` of what is there.

    Rows are counted, not values: a repeated id fills as many places as it has rows.
    """
    rank = F.col("_rank")
    return row_ranks(queries, by).where((rank >= offset) & (rank < offset + count)).drop("_rank")


def incremental_queries(existing: DataFrame, incoming: DataFrame, wanted: int) -> DataFrame:
    """The embedded set after growing it to ``wanted`` queries: ``(query_id, ..., origin)``.

    Existing queries come first (cut back when there are more than wanted),
    then the new ones with the smallest ids; exact row ranks make the cut.
    """
    have = existing.count()
    kept = existing.withColumn("origin", F.lit("existing"))
    if have >= wanted:
        return query_slice(kept, 0, wanted)
    new = incoming.join(existing.select("query_id"), "query_id", "left_anti").withColumn("origin", F.lit("new"))
    return kept.unionByName(query_slice(new, 0, wanted - have))


def query_leakage(queries: DataFrame) -> DataFrame:
    """How many held-out queries also occur in the workload, by id and by text.

    ``queries(query_id, query_text, split)``; an id may be in both splits.
    Counting per key instead of joining keeps copies of one text from meeting
    in one task.
    """
    keys = F.inline(F.array(
        F.struct(F.lit("id").alias("matched_by"), F.col("query_id").cast("string").alias("key")),
        F.struct(F.lit("text").alias("matched_by"), text.query_hash(F.col("query_text")).alias("key")),
    ))
    number = lambda split: F.count(F.when(F.col("split") == split, 1))
    per_key = queries.select("split", keys).groupBy("matched_by", "key").agg(
        number(WORKLOAD).alias("w"), number(HELD_OUT).alias("e")
    )
    return per_key.groupBy("matched_by").agg(
        F.sum("w").alias("n_workload"), F.sum("e").alias("n_held_out"),
        F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("e"))), F.lit(0)).alias("leaked"),
    )


def write_query_texts(texts: DataFrame, path: str) -> None:
    """One JSON object ``{query_id, query_text}`` per line."""
    texts.select("query_id", "query_text").write.mode("overwrite").json(path)


def read_query_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id bigint, query_text string").json(path)


def read_text_array(spark: SparkSession, path: str) -> DataFrame:
    """A file holding one JSON array of strings: ``(query_id, query_text)`` with the position as id."""
    return explode_texts(spark.read.text(path, wholetext=True), "value").select(
        F.col("pos").cast("bigint").alias("query_id"), "query_text"
    )


def explode_texts(df: DataFrame, column: str) -> DataFrame:
    """One row per string of a JSON array column, with its position."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(F.from_json(column, "array<string>")).alias("pos", "query_text"))


def cache_lookup(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split distinct texts into cached ones (with their vector) and misses, by md5 of the text.

    Copies of a text collapse before the join: each text is looked up once.
    """
    wanted = texts.groupBy(text.query_hash(F.col("query_text")).alias("query_md5")).agg(
        F.min("query_id").alias("query_id"), F.count(F.lit(1)).alias("n_queries")
    )
    stored = cache.select("query_md5", "model", "dimension", "embedding")
    return wanted.join(stored, "query_md5"), wanted.join(stored, "query_md5", "left_anti")


def cache_entries(embedded: DataFrame, model: str) -> DataFrame:
    """Cache rows for freshly embedded texts ``(query_text, embedding)``."""
    return embedded.select(
        text.query_hash(F.col("query_text")).alias("query_md5"), F.col("query_text").alias("query"),
        F.lit(model).alias("model"), F.size("embedding").alias("dimension"), "embedding",
    )


def append_to_cache(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Cache plus the entries it does not hold yet."""
    fresh = entries.join(cache.select("query_md5"), "query_md5", "left_anti")
    return cache.unionByName(one_entry_per_text(fresh))


def one_entry_per_text(entries: DataFrame) -> DataFrame:
    """Of several entries for a text the smallest one, so every run keeps the same vector."""
    rest = [c for c in entries.columns if c != "query_md5"]
    least = entries.groupBy("query_md5").agg(F.min(F.struct(*rest)).alias("_entry"))
    return least.select("query_md5", "_entry.*").select(*entries.columns)
