import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from thermocline.functions import tiers as rules
from thermocline.operators import access, migration

NOW = datetime(2024, 1, 31)
AS_OF = "2024-01-31 00:00:00"


def at():
    return F.lit(AS_OF).cast("timestamp_ntz")


def tier_map(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, tier int, seq bigint")


def score_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, score double")


def tiers_of(df):
    return {r["doc_id"]: r["tier"] for r in df.collect()}


def log_of(df):
    return sorted((r["doc_id"], r["from_tier"], r["to_tier"]) for r in df.collect())


@pytest.mark.parametrize("value,temperature,score", [(0.9, 1, 1), (0.8999, 2, 1), (0.7, 2, 1), (0.69, 3, 2), (0.3, 3, 2), (0.29, 3, 3)])
def test_absolute_rules_include_their_cuts(spark, value, temperature, score):
    row = spark.range(1).select(
        rules.by_temperature(F.lit(value)).alias("t"), rules.by_access_score(F.lit(value)).alias("s")
    ).first()
    assert (row["t"], row["s"]) == (temperature, score)


@pytest.mark.parametrize("label,tier", [
    ("hot (T1)", 1), ("warm (T2)", 2), ("cold (T3)", 3), ("redis", 1), ("LOCAL store", 2), ("remote", 3),
    ("T1 local", 1), ("other", None),
])
def test_label_buckets(spark, label, tier):
    assert spark.range(1).select(rules.tier_of_label(F.lit(label)).alias("t")).first()["t"] == tier


def test_cap_takes_first_in_registration_order(spark):
    tiers = tier_map(spark, [(d, 1, 100 - d) for d in range(25)])
    moves = migration.migration_candidates(tiers, score_table(spark, []), 20).collect()
    assert len(moves) == 20 and {m["action"] for m in moves} == {"demote"}
    assert {m["doc_id"] for m in moves} == set(range(5, 25))
    assert migration.migration_candidates(tiers, score_table(spark, []), cap=None).count() == 25


def test_pass_moves_one_step_and_logs_the_same_rows(spark):
    tiers = tier_map(spark, [(1, 3, 0), (2, 1, 1), (3, 2, 2), (4, 2, 3)])
    scores = score_table(spark, [(1, 0.9), (3, 0.5), (4, 0.8)])
    for cap in (20, None):
        new, log = migration.migration_pass(tiers, scores, at(), cap)
        assert tiers_of(new) == {1: 2, 2: 2, 3: 2, 4: 1}
        assert log_of(log) == [(1, 3, 2), (2, 1, 2), (4, 2, 1)]
        assert {r["kind"] for r in log.collect()} == {"auto"}


@pytest.mark.parametrize("cap", [1, 3, 1000])
def test_capped_passes_reach_the_uncapped_end(spark, cap):
    rng = random.Random(cap)
    tiers = tier_map(spark, [(d, rng.randint(1, 3), d) for d in range(5)])
    scores = score_table(spark, [(d, rng.random()) for d in range(5)])
    direct, walked = migration.migrate_until_stable(tiers, scores, at())
    looped, log = migration.migrate_capped_until_stable(tiers, scores, at(), cap)
    assert tiers_of(direct) == tiers_of(looped)
    assert log_of(walked) == log_of(log)
    assert migration.migration_candidates(direct, scores, None).isEmpty()


def test_moves_with_and_without_removal(spark):
    tiers = tier_map(spark, [(1, 3, 0), (1, 2, 5), (2, 1, 1)])
    moves = spark.createDataFrame([(1, 3, 2), (2, 1, 2)], "doc_id bigint, from_tier int, to_tier int")
    moved = migration.apply_moves(tiers, moves, remove=True, shared=True)
    assert sorted((r["doc_id"], r["tier"], r["seq"]) for r in moved.collect()) == [(1, 2, 0), (2, 2, 1)]
    copied = migration.apply_moves(tiers, moves, remove=False, shared=True)
    assert sorted((r["doc_id"], r["tier"], r["seq"]) for r in copied.collect()) == [
        (1, 2, 0), (1, 3, 0), (2, 1, 1), (2, 2, 1)]


def test_forced_moves(spark):
    tiers = tier_map(spark, [(1, 3, 0), (2, 2, 1), (3, 1, 2), (4, 3, 3)])
    asked = spark.createDataFrame([(1, 1), (2, 2), (3, 4), (4, 0), (9, 1)], "doc_id bigint, target_tier int")
    outcome, log, new = migration.force_migration(tiers, asked, at())
    assert {r["doc_id"]: r["success"] for r in outcome.collect()} == {1: True, 2: True, 3: False, 4: False, 9: False}
    assert log_of(log) == [(1, 2, 1), (1, 3, 2), (3, 1, 2), (3, 2, 3), (4, 2, 1), (4, 3, 2)]
    assert tiers_of(new) == {1: 1, 2: 2, 3: 3, 4: 1}
    history = {r["doc_id"]: (r["n_moves"], r["first_from"], r["last_to"]) for r in migration.migration_history(log).collect()}
    assert history == {1: (2, 3, 1), 3: (2, 1, 3), 4: (2, 3, 1)}


def test_stats_cutoff_is_strict(spark):
    log = spark.createDataFrame(
        [(1, datetime(2024, 1, 30), 1, 2, "auto"), (2, datetime(2024, 1, 30, 0, 0, 1), 1, 2, "forced")],
        "doc_id bigint, ts timestamp_ntz, from_tier int, to_tier int, kind string",
    )
    assert migration.migration_stats(log, at(), 24).first()["total_migrations"] == 1


def test_registration_keeps_first_position(spark):
    rows = [(1, 3, 10), (2, 1, 11), (1, 2, 12)]
    got = {(r["doc_id"], r["tier"], r["seq"]) for r in migration.register_tiers(tier_map(spark, rows)).collect()}
    assert got == {(1, 2, 10), (2, 1, 11)}


def test_status_counts_automatic_moves_only(spark):
    log = spark.createDataFrame(
        [(1, NOW, 3, 2, "auto"), (2, NOW, 3, 2, "forced")],
        "doc_id bigint, ts timestamp_ntz, from_tier int, to_tier int, kind string",
    )
    events = spark.createDataFrame([(1, NOW)], "doc_id bigint, ts timestamp_ntz")
    scored = access.access_scores(access.access_stats(events), AS_OF)
    report = migration.status_report(tier_map(spark, [(1, 2, 0), (2, 2, 1), (3, 1, 2)]), log, scored).collect()
    got = {(r["section"], r["key"]): r["value"] for r in report}
    assert got[("migrations", "total")] == 1
    assert got[("tier_distribution", "2")] == 2 and got[("tier_distribution", "1")] == 1
    assert got[("top_documents", "1")] == pytest.approx((0.01 + 1) / 2)
    assert got[("access_thresholds", "tier1")] == 0.7 and got[("temperature_thresholds", "tier2")] == 0.7


def test_access_scores_and_records(spark):
    rows = [(1, NOW)] * 250 + [(2, datetime(2024, 1, 30, 12)), (3, datetime(2024, 1, 1)), (4, datetime(2024, 2, 2))]
    events = spark.createDataFrame(rows, "doc_id bigint, ts timestamp_ntz")
    stats = access.access_stats(events, AS_OF)
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id bigint")
    got = {r["doc_id"]: r for r in access.access_records(docs, stats, AS_OF).collect()}
    assert got[1]["score"] == 1.0 and got[1]["total_accesses"] == 250
    assert got[2]["score"] == pytest.approx((0.01 + 0.5) / 2)
    assert got[3]["score"] == pytest.approx(0.005)
    for untouched in (4, 5):  # accessed after the cut-off, never accessed
        assert (got[untouched]["total_accesses"], got[untouched]["last_access"], got[untouched]["score"]) == (0, None, 0.0)


def test_top_accessed_breaks_ties_by_first_access(spark):
    late, early = datetime(2024, 1, 2), datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, late), (2, early), (3, NOW)], "doc_id bigint, ts timestamp_ntz")
    top = access.top_accessed(access.access_scores(access.access_stats(events), AS_OF), 2)
    assert [r["doc_id"] for r in top.collect()] == [3, 2]
