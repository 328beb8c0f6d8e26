"""The tier table: parquet partitioned by ``tier``, written, read, upserted and cleared with plain DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thermocline.functions import tiers as rules
from thermocline.session import materialize


def single_tier(docs: DataFrame, tier: int) -> DataFrame:
    """Baseline store: every document in one tier."""
    return docs.withColumn("tier", F.lit(tier))


def save_tiers(tiered: DataFrame, path: str) -> None:
    tiered.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("tier").parquet(path)


def load_tiers(spark: SparkSession, path: str, schema: StructType, tier: int | None = None) -> DataFrame:
    """The whole table, or one tier's partition only."""
    table = spark.read.schema(schema).parquet(path)
    return table if tier is None else table.where(F.col("tier") == tier)


def hot_in_memory(tiered: DataFrame) -> DataFrame:
    """The same table with its hot tier kept by the executors (on disk where memory is short).

    The colder tiers stay files; a search of one tier still reads only that tier.
    """
    hot = F.col("tier") == rules.HOT
    return tiered.where(hot).persist().unionByName(tiered.where(~hot))


def rebuild_tier(spark: SparkSession, path: str, tiered: DataFrame, tier: int) -> None:
    """Clear one tier and refill it from ``tiered`` (which must not read ``path``); other tiers stay untouched.

    A tier without documents afterwards has no folder: an overwrite only
    replaces partitions it writes, so that one is removed.
    """
    part = materialize(tiered.where(F.col("tier") == tier), "tier")
    if part.isEmpty():
        clear_tier(spark, path, tier)
    else:
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier").parquet(path)


def clear_tier(spark: SparkSession, path: str, tier: int) -> None:
    """Remove every document of a tier from the stored table."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/tier={tier}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def delete_documents(spark: SparkSession, path: str, schema: StructType, ids: DataFrame) -> None:
    """Delete documents by id from the stored table; only tiers that hold one of them are written again."""
    for tier in (rules.HOT, rules.WARM, rules.COLD):
        stored = load_tiers(spark, path, schema, tier)
        if not get_documents(stored, ids).isEmpty():
            rebuild_tier(spark, path, without_documents(stored, ids), tier)


def latest_copies(stored: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Latest row per (tier, document).

    The row number is limited to 1 before the shuffle too, so a document with
    very many copies sends one row per task.
    """
    newest = W.partitionBy("tier", "doc_id").orderBy(*[F.desc(c) for c in order])
    return stored.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Store documents in their tier. A copy left in another tier stays there."""
    return latest_copies(existing.unionByName(incoming))


def get_documents(tiered: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents asked for by id; an id may be asked for any number of times."""
    return tiered.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def without_documents(tiered: DataFrame, ids: DataFrame) -> DataFrame:
    return tiered.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
