"""The tier table as files by (tier, bucket), changed in place.

A document's bucket is a hash of its id, the same in every tier. An upsert, a
move or a delete reads and writes only the (tier, bucket) folders its ids fall into: they are
found from the ids alone, other folders are neither listed into the scan (dynamic partition pruning) nor
written (dynamic partition overwrite), so a change costs the folders it touches, not the table.

A change is worked out into the shared folder first and then replaces the touched folders in one commit; folders that
hold nothing any more are removed. Every change can be run again with the same input and leads to the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thermocline.session import materialize

FOLDER_BYTES = 128 * 1024 * 1024


@dataclass(frozen=True)
class BucketStore:
    path: str
    buckets: int
    schema: StructType  # the documents' columns, then tier and bucket


def buckets_for(rows: int, row_bytes: int, folder_bytes: int = FOLDER_BYTES) -> int:
    """As many buckets as keep a folder near ``folder_bytes`` if one tier held every document."""
    return max(1, -(-rows * row_bytes // folder_bytes))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def create(tiered: DataFrame, path: str, buckets: int) -> BucketStore:
    """Store ``tiered(doc_id, tier, ...)``; ids and tiers are not null."""
    columns = [c for c in tiered.columns if c not in ("tier", "bucket")]
    rows = tiered.select(*columns, F.col("tier").cast("int").alias("tier"), _bucket(buckets).alias("bucket"))
    store = BucketStore(path, buckets, rows.schema)
    _write(rows, store, "errorifexists")
    return store


def read(spark: SparkSession, store: BucketStore, tier: int | None = None) -> DataFrame:
    """The documents, or those of one tier, without their bucket."""
    rows = spark.read.schema(store.schema).parquet(store.path).drop("bucket")
    return rows if tier is None else rows.where(F.col("tier") == tier)


def upsert(store: BucketStore, incoming: DataFrame, order: str = "seq") -> None:
    """Put documents into their tier: the highest ``order`` among the incoming replaces the stored copy.

    A copy in another tier stays there.
    """
    fresh = incoming.withColumn("bucket", _bucket(store.buckets)).select(*store.schema.names)
    newest = W.partitionBy("tier", "doc_id").orderBy(F.desc(order))
    fresh = materialize(fresh.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n"), "upserts")
    touched = fresh.select("tier", "bucket")
    kept = _folders(store, touched).join(fresh.select("tier", "bucket", "doc_id"), ["tier", "bucket", "doc_id"], "left_anti")
    _replace(store, touched, kept.unionByName(fresh))


def move(store: BucketStore, moves: DataFrame, remove: bool = True) -> None:
    """Apply ``moves(doc_id, from_tier, to_tier)`` with everything stored next to the ids.

    A moved document replaces a copy its new tier already has; with ``remove=False`` the
    old copy stays. A move without a stored copy does nothing. One move per (document, tier).
    """
    steps = materialize(moves.select(
        "doc_id", F.col("from_tier").cast("int").alias("tier"), F.col("to_tier").cast("int").alias("to_tier"),
        _bucket(store.buckets).alias("bucket")), "moves")
    touched = steps.select(F.explode(F.array("tier", "to_tier")).alias("tier"), "bucket")
    stored = _folders(store, touched).join(steps, ["tier", "bucket", "doc_id"], "left")
    target = F.col("to_tier")
    stays = F.struct(F.col("tier").alias("tier"), F.lit(0).alias("moved"))
    goes = F.struct(target.alias("tier"), F.lit(1).alias("moved"))
    ends = F.when(target.isNull(), F.array(stays)).otherwise(F.array(goes) if remove else F.array(stays, goes))
    rest = [c for c in store.schema.names if c != "tier"]
    spread = stored.select(*rest, F.explode(ends).alias("_end")).select(*rest, "_end.tier", "_end.moved")
    first = W.partitionBy("bucket", "tier", "doc_id")
    # where a copy arrives, older copies of the document go
    arrived = spread.withColumn("_arrived", F.max("moved").over(first)).where(F.col("moved") == F.col("_arrived"))
    _replace(store, touched, arrived.select(*store.schema.names))


def delete(store: BucketStore, ids: DataFrame) -> None:
    """Delete documents by id from every tier."""
    gone = materialize(ids.select("doc_id").distinct().withColumn("bucket", _bucket(store.buckets)), "deletes")
    hit = materialize(_folders(store, gone.select("bucket"), ["bucket"]).join(gone, ["bucket", "doc_id"], "left_semi")
                      .select("tier", "bucket").distinct(), "touched")  # only tiers that hold one of the ids
    kept = _folders(store, hit).join(gone, ["bucket", "doc_id"], "left_anti")
    _replace(store, hit, kept)


def _folders(store: BucketStore, touched: DataFrame, keys: list[str] = ["tier", "bucket"]) -> DataFrame:
    """Stored rows of the touched folders: at most one row per folder is broadcast."""
    spark = touched.sparkSession
    wanted = touched.where(F.col("bucket") >= 0).select(*keys).distinct()
    return spark.read.schema(store.schema).parquet(store.path).join(F.broadcast(wanted), keys, "left_semi").select(*store.schema.names)


def _write(rows: DataFrame, store: BucketStore, mode: str) -> None:
    rows.repartition("tier", "bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(
        "tier", "bucket").parquet(store.path)


def _replace(store: BucketStore, touched: DataFrame, rows: DataFrame) -> None:
    spark = touched.sparkSession
    touched = materialize(touched.distinct(), "touched")
    after = materialize(rows, "rewritten")
    # one row per touched folder
    empty = touched.join(after.select("tier", "bucket").distinct(), ["tier", "bucket"], "left_anti").collect()
    _write(after, store, "overwrite")
    for row in empty:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.path}/tier={row['tier']}/bucket={row['bucket']}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
