import glob
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from thermocline.operators import access, migration, retrieval
from thermocline.session import scratch_path
from thermocline.streaming import jobs
from tests.test_similarity import frame

EVENTS = "event_id bigint, doc_id bigint, ts timestamp_ntz"
AS_OF = "2024-01-31 00:00:00"
START = datetime(2024, 1, 30)


def landed(spark, frames, name):
    """Several files that arrive one after another."""
    folder = scratch_path(spark, name)
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)
    return folder


def event_frames(spark):
    rows = [(i, i % 4, START + timedelta(minutes=i)) for i in range(60)]
    return [spark.createDataFrame(rows[at : at + 20], EVENTS) for at in (0, 20, 40)]


def counts(df):
    return {r["doc_id"]: (r["total_accesses"], r["last_access"]) for r in df.collect()}


def test_running_counts_equal_batch_counts(spark):
    frames = event_frames(spark)
    stream = jobs.stream_table(spark, landed(spark, frames, "events"), EVENTS, max_files=1)
    path = scratch_path(spark, "counts")
    jobs.count_accesses(stream, path).awaitTermination()
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    assert counts(jobs.read_access_counts(spark, path)) == counts(access.access_stats(whole))


def test_redelivered_events_count_once(spark):
    frames = event_frames(spark)
    again = [frames[0], frames[0].unionByName(frames[1]), frames[2]]
    stream = jobs.stream_table(spark, landed(spark, again, "events"), EVENTS, max_files=1)
    path = scratch_path(spark, "counts")
    jobs.count_accesses(stream, path, once=True).awaitTermination()
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    got = {r["doc_id"]: r["total_accesses"] for r in jobs.read_access_counts(spark, path).collect()}
    assert got == {r["doc_id"]: r["total_accesses"] for r in access.access_stats(whole).collect()}


def test_a_replayed_batch_replaces_itself(spark):
    folder = landed(spark, event_frames(spark), "events")
    path = scratch_path(spark, "counts")
    for _ in range(2):  # a lost checkpoint replays every batch
        jobs.count_accesses(jobs.stream_table(spark, folder, EVENTS), path).awaitTermination()
    assert sum(n for n, _ in counts(jobs.read_access_counts(spark, path)).values()) == 60


def test_store_stream_keeps_the_latest_copy_per_tier(spark):
    request = lambda doc, temperature: f'{{"doc_id": {doc}, "embedding": [1.0, 2.0], "temperature": {temperature}}}'
    schema = "body string, seq bigint"
    frames = [
        spark.createDataFrame([(request(1, 0.95), 0), (request(2, 0.1), 1), ("{", 2)], schema),
        spark.createDataFrame([(request(1, 0.92), 3), (request(1, 0.75), 4)], schema),
    ]
    stream = jobs.stream_table(spark, landed(spark, frames, "requests"), schema, max_files=1)
    path = scratch_path(spark, "store")
    jobs.store_documents(stream, path).awaitTermination()
    stored = {(r["doc_id"], r["tier"], r["temperature"]) for r in jobs.read_stored(spark, path).collect()}
    assert stored == {(1, 1, 0.92), (1, 2, 0.75), (2, 3, 0.1)}
    assert [(r["seq"], r["reason"]) for r in jobs.read_rejected(spark, path).collect()] == [(2, "malformed")]


def test_streamed_answers_equal_batch_answers(spark):
    docs = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [-1.0, 0.0]]
    tiered = frame(spark, docs, "doc_id").withColumn("tier", (F.col("doc_id") % 3 + 1).cast("int")).cache()
    first, second = frame(spark, [[1.0, 0.1]], "query_id"), frame(spark, [[0.1, 1.0], [-1.0, 0.2]], "query_id", 10)
    stream = jobs.stream_table(
        spark, landed(spark, [first, second], "queries"), "query_id bigint, embedding array<float>", max_files=1
    )
    path = scratch_path(spark, "answers")
    jobs.answer_queries(stream, tiered, path, 2, 0.1).awaitTermination()
    columns = ["query_id", "rank", "doc_id", "tier", "source"]
    batch = retrieval.cascade_topk(tiered, first.unionByName(second), 2, 0.1).select(columns)
    assert sorted(map(tuple, jobs.read_answers(spark, path).select(columns).collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("cap,every", [(None, 2), (1, 1), (1, 32)])
def test_migration_after_every_batch(spark, cap, every):
    frames = event_frames(spark)
    tiers = spark.createDataFrame([(d, 3 - d % 3, d) for d in range(6)], "doc_id bigint, tier int, seq bigint")
    at = F.lit(AS_OF).cast("timestamp_ntz")
    stream = jobs.stream_table(spark, landed(spark, frames, "events"), EVENTS, max_files=1)
    path = scratch_path(spark, "migrate")
    jobs.migrate_on_access(stream, tiers, path, AS_OF, at, cap, snapshot_every=every).awaitTermination()

    seen, current, moves = None, tiers, set()
    for number, df in enumerate(frames):
        seen = df if seen is None else seen.unionByName(df)
        scores = access.access_scores(access.access_stats(seen), AS_OF)
        new, log = migration.migration_pass(current, scores, at, cap)
        moves |= {(number, r["doc_id"], r["from_tier"], r["to_tier"]) for r in log.collect()}
        current = new
    log = jobs.read_migration_log(spark, path)
    assert {(r["batch_id"], r["doc_id"], r["from_tier"], r["to_tier"]) for r in log.collect()} == moves
    final = {r["doc_id"]: r["tier"] for r in jobs.current_tiers(tiers, log).collect()}
    assert final == {r["doc_id"]: r["tier"] for r in current.collect()}


def test_late_and_redelivered_events_count_once(spark):
    """Out of order by more than any watermark, some of them twice."""
    rows = [(i, i % 3, START - timedelta(days=10 * (i % 4))) for i in range(12)] + [(None, 1, START), (None, 1, START)]
    parts = [rows[:5], rows[3:9], rows[8:] + rows[:2]]
    stream = jobs.stream_table(spark, landed(spark, [spark.createDataFrame(p, EVENTS) for p in parts], "late"), EVENTS, max_files=1)
    path = scratch_path(spark, "counts")
    jobs.count_accesses(stream, path, once=True).awaitTermination()
    assert counts(jobs.read_access_counts(spark, path)) == counts(access.access_stats(spark.createDataFrame(rows, EVENTS)))


def test_migration_ignores_events_after_as_of_and_can_follow_the_stream(spark):
    frames = event_frames(spark)
    early = str(START + timedelta(minutes=30))
    tiers = spark.createDataFrame([(d, 3, d) for d in range(4)], "doc_id bigint, tier int, seq bigint")
    stream = lambda: jobs.stream_table(spark, landed(spark, frames, "events"), EVENTS, max_files=1)
    path = scratch_path(spark, "as-of")
    jobs.migrate_on_access(stream(), tiers, path, early, F.lit(early).cast("timestamp_ntz"), None).awaitTermination()
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    stats = spark.read.parquet(f"{path}/access").groupBy("doc_id").agg(F.sum("total_accesses").alias("n"))
    assert {r["doc_id"]: r["n"] for r in stats.collect()} == {
        r["doc_id"]: r["total_accesses"] for r in access.access_stats(whole, early).collect()}
    path = scratch_path(spark, "follows")
    jobs.migrate_on_access(stream(), tiers, path, None, None, None).awaitTermination()
    times = [r["ts"] for r in jobs.read_migration_log(spark, path).select("batch_id", "ts").distinct().orderBy("batch_id").collect()]
    assert times == sorted(times) and times[0] == START + timedelta(minutes=19)


def test_a_table_of_one_file_or_of_many_is_streamed_whole(spark):
    whole = event_frames(spark)[0]
    root = scratch_path(spark, "stored")
    whole.coalesce(1).write.parquet(f"{root}/one")
    shutil.copy(glob.glob(f"{root}/one/part-*.parquet")[0], f"{root}/file.parquet")
    whole.repartition(3).write.parquet(f"{root}/folder.parquet")
    for name in ("file", "folder"):
        path = scratch_path(spark, "counts")
        jobs.count_accesses(jobs.stream_stored(spark, root, name, EVENTS), path).awaitTermination()
        assert counts(jobs.read_access_counts(spark, path)) == counts(access.access_stats(whole))
