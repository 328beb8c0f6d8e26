"""Timers against batch passes at every watermark, and keyed de-duplication."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.test_streaming import EVENTS, counts, landed
from thermocline.operators import access, migration
from thermocline.session import scratch_path
from thermocline.streaming import decay, jobs

START = datetime(2024, 1, 1)
CUTS = (0.7, 0.3)


def test_scores_and_crossings_agree_with_the_column_expression(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 5, 39, 40, 41, 60, 99, 100, 140, 250]), rng.randrange(0, 30 * 3600) * 10**6 + rng.randrange(10**6)) for i in range(300)]
    base = START
    frame = spark.createDataFrame([(i, n, base, base + timedelta(microseconds=gone)) for i, n, gone in rows],
                                  "doc_id int, n long, last timestamp_ntz, now timestamp_ntz")
    from thermocline.functions import tiers as rules

    found = {r["doc_id"]: r["s"] for r in frame.select("doc_id", rules.access_score(F.col("n"), F.col("last"), F.col("now")).alias("s")).collect()}
    for i, n, gone in rows:
        assert decay.score(n, 0, gone) == found[i]
        change = decay.next_change(n, 0, gone, CUTS)
        here = decay.target(n, 0, gone, CUTS)
        if change is None:
            assert decay.target(n, 0, gone + 100 * 3600 * 10**6, CUTS) == here
        else:
            assert change * 1000 > gone
            assert decay.target(n, 0, change * 1000 + 1000, CUTS) > here
            assert change * 1000 - 2000 <= gone or decay.target(n, 0, change * 1000 - 2000, CUTS) == here


def passes(spark, batches, tiers, delay):
    """The batch job at every watermark: (moves, tiers in the end)."""
    current, moves, top, before, seen = tiers, [], None, None, []
    for rows in batches:
        kept = [r for r in rows if before is None or r[2] >= before]  # behind the watermark: dropped
        seen += kept
        top = max([r[2] for r in rows] + ([top] if top else []))
        mark = top - delay
        if mark == before:
            continue
        before = mark
        frame = spark.createDataFrame(seen, EVENTS)
        scores = access.access_scores(access.access_stats(frame, str(mark)), str(mark))
        current, log = migration.migration_pass(current, scores, F.lit(mark), None)
        current = spark.createDataFrame([tuple(r) for r in current.collect()], tiers.schema)
        moves += [(r["doc_id"], mark, r["from_tier"], r["to_tier"]) for r in log.collect()]
    return sorted(moves), {r["doc_id"]: r["tier"] for r in current.collect()}


@pytest.mark.parametrize("delay", [0, 7])
def test_timers_equal_batch_passes_at_every_watermark(spark, delay):
    rng = random.Random(delay)
    batches, number = [], 0
    for day in range(7):
        rows = []
        for doc in range(14):
            if day in (1, 4) and doc % 3:  # quiet days for most documents
                continue
            for _ in range(rng.choice([0, 1, 30, 80])):
                back = timedelta(hours=rng.randrange(delay + 1)) if delay else timedelta()
                rows.append((number, doc, START + timedelta(days=day, hours=10) + timedelta(seconds=rng.randrange(36000)) - back))
                number += 1
        rows.append((number, 99, START + timedelta(days=day, hours=20)))  # a document without a tier
        number += 1
        batches.append(rows)
    tiers = spark.createDataFrame([(d, d % 3 + 1, d) for d in range(16)], "doc_id bigint, tier int, seq bigint")
    folder = landed(spark, [spark.createDataFrame(r, EVENTS) for r in batches], "decay-events")
    stream = jobs.stream_table(spark, folder, EVENTS, max_files=1)
    path = scratch_path(spark, "decay")
    decay.migrate_on_time(stream, tiers, path, f"{delay} hours").awaitTermination()
    log = jobs.read_migration_log(spark, path)
    want, final = passes(spark, batches, tiers, timedelta(hours=delay))
    assert sorted((r["doc_id"], r["ts"], r["from_tier"], r["to_tier"]) for r in log.collect()) == want
    assert len(want) > 30 and any(a < b for _, _, a, b in want) and any(a > b for _, _, a, b in want)
    assert {r["doc_id"]: r["tier"] for r in jobs.current_tiers(tiers, log).collect()} == final


def test_state_survives_a_restart(spark):
    """The job stops after every file and goes on from its checkpoint; ids and totals are kept."""
    rows = [(i, i % 3, START + timedelta(minutes=i)) for i in range(30)]
    parts = [rows[:12], rows[4:20], rows[:3] + rows[18:], rows[:30]]
    folder, path, check = scratch_path(spark, "restart"), scratch_path(spark, "counts"), scratch_path(spark, "check")
    sizes = []
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        jobs.count_accesses(jobs.stream_table(spark, folder, EVENTS), path, check, once=True).awaitTermination()
        sizes.append(spark.read.parquet(path).count())
    assert counts(jobs.read_access_counts(spark, path)) == counts(access.access_stats(spark.createDataFrame(rows, EVENTS)))
    assert sizes[-1] == sizes[-2]  # a batch of nothing but repeats writes no total


def test_ids_are_let_go_within_a_watermark(spark):
    rows = [(i, i % 3, START + timedelta(hours=i)) for i in range(12)]
    parts = [rows[:6] + rows[:6], rows[4:12], rows[11:]]
    folder = landed(spark, [spark.createDataFrame(p, EVENTS) for p in parts], "within")
    path = scratch_path(spark, "within-counts")
    jobs.count_accesses(jobs.stream_table(spark, folder, EVENTS, max_files=1), path, once=True, within="2 days").awaitTermination()
    assert counts(jobs.read_access_counts(spark, path)) == counts(access.access_stats(spark.createDataFrame(rows, EVENTS)))


def test_a_document_is_read_and_written_once_a_batch_however_many_accesses_it_has():
    """Before, every access cost three calls of the state store, and those of unknown documents were kept."""
    class Store:
        def __init__(self, held):
            self.held, self.calls = held, 0

        def __getattr__(self, name):
            def call(*arguments):
                self.calls += 1
                if name == "update":
                    self.held = arguments[0]
                return {"getValueState": self, "getMapState": self, "get": self.held, "exists": self.held is not None,
                        "containsKey": False, "listTimers": []}.get(name)
            return call

        def getCurrentWatermarkInMs(self):
            return 0

    for held in ((0, 0, 3, None, b""), None):
        store = Store(held)
        job = decay.Decay(CUTS)
        job.init(store)
        store.calls = 0
        list(job.handleInputRows((1,), iter([Row(micros=i * 1000) for i in range(1, 51)]), store))
        assert store.calls <= 3 and (store.held is None) == (held is None)
