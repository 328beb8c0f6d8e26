"""Structured Streaming jobs: access counting, document ingest, query answering, migration.

Every sink is a folder ``batch_id=N`` written with overwrite, so a batch that
is replayed after a failure replaces its own output and nothing else. State
that outlives a batch is read from the folders of earlier batches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from thermocline.operators.access import access_scores, moment
from thermocline.operators.migration import migration_pass
from thermocline.operators.retrieval import cascade_staged
from thermocline.operators.tier_table import latest_copies
from thermocline.session import materialize, scratch_path
from thermocline.sources.vectors import accepted, parse_store_requests, rejected


def stream_table(spark: SparkSession, folder: str, schema: StructType | str, max_files: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def stream_stored(spark: SparkSession, sf_dir: str, name: str, schema: StructType | str) -> DataFrame:
    """A stored table as a stream, be it one file or a folder of files: a stream takes either from a glob."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def _batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


ONCE = {"availableNow": True}  # what has arrived; {"processingTime": "10 seconds"} keeps a job running


STATE_STORE = "spark.sql.streaming.stateStore"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Keyed state on the executors' disks; a commit uploads what changed in the batch, not the whole state."""
    spark.conf.set(f"{STATE_STORE}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(f"{STATE_STORE}.rocksdb.changelogCheckpointing.enabled", "true")


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time as it stands, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts.cast("timestamp_ntz"))


def write_batches(path: str):
    """A sink with one folder per batch."""
    return lambda df, batch: df.write.mode("overwrite").parquet(_batch_folder(path, batch))


def start_stream(stream: DataFrame, handle, checkpoint: str | None, trigger: dict, mode: str = "append") -> StreamingQuery:
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream-checkpoint")
    return (
        stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )


# -- access counting -------------------------------------------------------


def count_accesses(events: DataFrame, path: str, checkpoint: str | None = None, once: bool = False,
                   within: str | None = None, trigger: dict = ONCE) -> StreamingQuery:
    """Running count and last access of each document; ``events(event_id, doc_id, ts)``.

    With ``once`` a redelivered ``event_id`` counts once, however late it comes: the ids
    are keyed state, so a batch looks up its own ids and reads nothing else of the past. ``within`` (such as "2 days")
    lets go of ids the watermark has passed by so much, which bounds the state; events behind
    the watermark are then dropped. Events without an id all count. Copies of an event are taken to be equal.

    A batch writes the new totals of the documents it touches.
    """
    if once:
        keep_state_in_rocksdb(events.sparkSession)
        named = events.where("event_id IS NOT NULL")
        if within is None:
            named = named.dropDuplicates(["event_id"])
        else:
            named = (named.withColumn("_at", F.timestamp_micros(micros(F.col("ts")))).withWatermark("_at", within)
                     .dropDuplicatesWithinWatermark(["event_id"]).drop("_at"))
        events = named.unionByName(events.where("event_id IS NULL"))
    return start_stream(_access_partial(events), write_batches(path), checkpoint, trigger, "update")


def _access_partial(events: DataFrame) -> DataFrame:
    return events.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_accesses"), F.max("ts").alias("last_access"), F.min("ts").alias("first_access")
    )


def read_access_counts(spark: SparkSession, path: str) -> DataFrame:
    """Latest state: running totals only grow, so the largest is the latest."""
    return spark.read.parquet(path).groupBy("doc_id").agg(
        F.max("total_accesses").alias("total_accesses"), F.max("last_access").alias("last_access"),
        F.min("first_access").alias("first_access"),
    )


# -- document ingest -------------------------------------------------------


def store_documents(requests: DataFrame, path: str, checkpoint: str | None = None, dimension: int | None = None,
                    trigger: dict = ONCE) -> StreamingQuery:
    """JSON requests ``(body, seq)`` into the tier their temperature asks for; rejects are kept with a reason."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_store_requests(batch, dimension=dimension)
        valid = accepted(parsed).select("doc_id", "embedding", "temperature", "tier", "seq")
        latest_copies(valid).write.mode("overwrite").partitionBy("tier").parquet(
            _batch_folder(f"{path}/stored", batch_id)
        )
        rejected(parsed).select("seq", "reason", "body").write.mode("overwrite").parquet(
            _batch_folder(f"{path}/rejected", batch_id)
        )

    return start_stream(requests, handle, checkpoint, trigger)


STORED_SCHEMA = "doc_id bigint, embedding array<float>, temperature double, seq bigint, batch_id bigint, tier int"


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Latest copy per (tier, document) over all batches."""
    stored = spark.read.schema(STORED_SCHEMA).option("basePath", f"{path}/stored").parquet(f"{path}/stored")
    return latest_copies(stored, ("batch_id", "seq")).drop("batch_id")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq bigint, reason string, body string").parquet(f"{path}/rejected")


# -- query answering -------------------------------------------------------


def answer_queries(queries: DataFrame, tiered: DataFrame, path: str, k: int, threshold: float,
                   checkpoint: str | None = None, trigger: dict = ONCE) -> StreamingQuery:
    """Cascaded top-k for a stream of query vectors against a static tier table.

    Tier by tier: a micro-batch reads a colder tier only for queries that are still short of k.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        asked = materialize(batch, "asked")  # read for its size and for its vectors
        cascade_staged(tiered, asked, k, threshold).write.mode("overwrite").parquet(_batch_folder(path, batch_id))

    return start_stream(queries, handle, checkpoint, trigger)


HITS_SCHEMA = "query_id bigint, tier int, doc_id bigint, score double, rank int, source string"


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HITS_SCHEMA).parquet(path)


# -- migration -------------------------------------------------------------

LOG_SCHEMA = "doc_id bigint, ts timestamp_ntz, from_tier int, to_tier int, kind string, batch_id bigint"
_MOVED_SCHEMA = "doc_id bigint, to_tier int, batch_id bigint"
SNAPSHOT_EVERY = 32  # batches between two snapshots of the folded state


def migrate_on_access(events: DataFrame, tiers: DataFrame, path: str, as_of: str | None, ts: Column | None, cap: int | None,
                      checkpoint: str | None = None, snapshot_every: int = SNAPSHOT_EVERY,
                      trigger: dict = ONCE) -> StreamingQuery:
    """After every micro-batch of accesses: update the counts and run one migration pass.

    Events after ``as_of`` have not happened yet, as in the batch form. Without
    ``as_of`` time moves with the stream: each batch is scored, and its moves
    logged (where ``ts`` is not given), as of the latest event so far.

    ``tiers`` is the state before the stream. Each batch adds its own counts
    and its own moves; every ``snapshot_every`` batches both are folded into a
    snapshot, so a batch reads one snapshot and a bounded number of additions.
    """
    spark = events.sparkSession
    when = events.schema["ts"].dataType.simpleString()
    access_schema = f"doc_id bigint, total_accesses bigint, last_access {when}, first_access {when}, batch_id bigint"

    def handle(batch: DataFrame, batch_id: int) -> None:
        write = lambda df, part: df.write.mode("overwrite").parquet(_batch_folder(f"{path}/{part}", batch_id))
        if as_of is not None:
            batch = batch.where(F.col("ts") <= moment(as_of, batch, "ts"))
        write(_access_partial(batch), "access")
        stats = _fold_access(_since_snapshot(spark, path, "access", access_schema, batch_id, batch_id, snapshot_every))
        moved = _since_snapshot(spark, path, "log", _MOVED_SCHEMA, batch_id, batch_id - 1, snapshot_every)
        now = as_of if as_of is not None else str(stats.agg(F.max("last_access")).first()[0] or "1970-01-01")
        stamp = ts if ts is not None else F.lit(now).cast("timestamp_ntz")
        _, log = migration_pass(current_tiers(tiers, moved), access_scores(stats, now), stamp, cap)
        write(log, "log")
        if batch_id % snapshot_every == snapshot_every - 1:
            write(stats, "access-snapshot")
            moved = _since_snapshot(spark, path, "log", _MOVED_SCHEMA, batch_id, batch_id, snapshot_every)
            write(_latest_moves(moved), "log-snapshot")

    return start_stream(events, handle, checkpoint, trigger)


def _since_snapshot(spark: SparkSession, path: str, part: str, schema: str, batch_id: int, upto: int, every: int) -> DataFrame:
    """The last snapshot before ``batch_id`` and the additions after it, up to batch ``upto``."""
    last = batch_id // every * every - 1
    read = lambda folders, base: spark.read.schema(schema).option("basePath", base).parquet(*folders)
    found = spark.createDataFrame([], schema)
    if last >= 0:
        base = f"{path}/{part}-snapshot"
        found = found.unionByName(read([_batch_folder(base, last)], base))
    if upto > last:
        base = f"{path}/{part}"
        found = found.unionByName(read([_batch_folder(base, number) for number in range(last + 1, upto + 1)], base))
    return found


def _fold_access(parts: DataFrame) -> DataFrame:
    return parts.groupBy("doc_id").agg(
        F.sum("total_accesses").alias("total_accesses"), F.max("last_access").alias("last_access"),
        F.min("first_access").alias("first_access"),
    )


def _latest_moves(log: DataFrame) -> DataFrame:
    return log.groupBy("doc_id").agg(F.max_by("to_tier", "batch_id").alias("to_tier"))


def read_migration_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log")


def current_tiers(tiers: DataFrame, log: DataFrame) -> DataFrame:
    """The tiers a log leads to: a document's latest logged move decides."""
    moved = _latest_moves(log).withColumnRenamed("to_tier", "_now")
    return tiers.join(moved, "doc_id", "left").withColumn("tier", F.coalesce("_now", "tier")).select(*tiers.columns)
