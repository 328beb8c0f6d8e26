"""Maintained temperatures, sketches, the capped schedule and the threshold sweep against plain re-computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_migration import at, score_table, tier_map
from tests.test_similarity import BLOCKS, frame
from thermocline.operators import maintained, migration, retrieval, schedule, sketches, sweep, tiering
from thermocline.session import materialize


def test_maintained_temperatures_equal_a_rebuild(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(90, 8))
    vectors[3], vectors[4] = 0, vectors[5]
    vectors[6, 1] = np.nan
    docs, queries = frame(spark, vectors, "doc_id"), frame(spark, rng.normal(size=(40, 8)), "query_id")
    part = lambda df, low, high: df.where((F.col(df.columns[0]) >= low) & (F.col(df.columns[0]) < high))
    state = maintained.warm_up(part(docs, 0, 60), part(queries, 0, 20))
    state = maintained.change(state, part(queries, 0, 30), added_queries=part(queries, 20, 30), removed_docs=part(docs, 0, 3), layout=BLOCKS)
    state = maintained.change(state, part(queries, 10, 30), removed_queries=part(queries, 0, 10), added_docs=part(docs, 60, 90))
    state = maintained.change(state, part(queries, 10, 40), part(queries, 30, 40), None, part(docs, 0, 2), part(docs, 50, 55))
    kept = docs.where(~F.col("doc_id").isin(2, *range(50, 55)))
    want = {r["doc_id"]: r["temperature"] for r in tiering.temperatures(kept, part(queries, 10, 40)).collect()}
    got = {r["doc_id"]: r["temperature"] for r in maintained.temperatures_of(state).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=2e-9) for d in want)
    assert maintained.change(state, queries).count() == len(want)


def test_merged_sketches_keep_the_rank_error(spark):
    rows = [(i % 3, i % 10, float((i * 7919) % 30011) ** 2) for i in range(30000)] + [(0, 1, None), (1, 2, float("nan"))]
    rows += [(7, 0, 1.0)] * 2000 + [(8, 0, 5.0)]
    data = materialize(spark.createDataFrame(rows, "system int, day int, v double").repartition(5), "values")
    days = sketches.sketches(data, ["system", "day"], "v")
    found = sketches.quantiles(sketches.merged(days, ["system"]), ["system"], (0.0, 0.5, 0.99, 1.0))
    assert {r["system"]: r["n"] for r in found.collect()} == {0: 10000, 1: 10000, 2: 10000, 7: 2000, 8: 1}
    errors = sketches.rank_errors(data, ["system"], "v", found).collect()
    assert len(errors) == 20 and all(r["rank_error"] <= sketches.RANK_ERROR for r in errors)
    assert any(r["rank_error"] > 0.2 for r in sketches.rank_errors(data, ["system"], "v", found.withColumn("share", F.lit(0.1))).collect())
    assert sketches.merged(sketches.sketches(data.where("day < 0"), ["system"], "v"), ["system"]).count() == 0


def plain_passes(tiers, scores, cap):
    """Pass by pass, the first ``cap`` waiting documents in registration order."""
    target = lambda d: 1 if scores.get(d, 0) >= 0.7 else 2 if scores.get(d, 0) >= 0.3 else 3
    now, log, number = {d: t for d, t, _ in tiers}, [], 0
    order = [d for d, _, _ in sorted(tiers, key=lambda r: (r[2], r[0]))]
    while waiting := [d for d in order if now[d] != target(d)][:cap]:
        number += 1
        for d in waiting:
            step = now[d] + (1 if target(d) > now[d] else -1)
            log.append((d, now[d], step, number))
            now[d] = step
    return sorted(log)


@pytest.mark.parametrize("cap,block,n", [(1, 4, 30), (2, 8, 60), (3, 5, 60), (7, 1 << 16, 60), (20, 16, 60), (100, 4, 60), (4, 4, 0)])
def test_pass_numbers_equal_repeated_passes(spark, monkeypatch, cap, block, n):
    monkeypatch.setattr(schedule, "BLOCK", block)
    rng = random.Random(cap)
    rows = [(d, rng.choice([1, 1, 3, 2]), rng.randrange(n)) for d in range(n)]
    scores = {d: rng.choice([0.0, 0.1, 0.5, 0.9, 0.95]) for d in range(n)}
    new, log = migration.migrate_capped_until_stable(tier_map(spark, rows), score_table(spark, list(scores.items())), at(), cap)
    assert sorted((r["doc_id"], r["from_tier"], r["to_tier"], r["pass"]) for r in log.collect()) == plain_passes(rows, scores, cap)
    assert migration.migration_candidates(new, score_table(spark, list(scores.items())), None).isEmpty()


def test_jobs_do_not_grow_with_the_passes(spark):
    rows = [(d, 1, d) for d in range(40)]
    counted = []
    for cap in (1, 40):
        spark.sparkContext.setJobGroup(f"passes-{cap}", "")
        _, log = migration.migrate_capped_until_stable(tier_map(spark, rows), score_table(spark, [(0, 0.0)]), at(), cap)
        assert log.agg(F.max("pass")).first()[0] == (2 if cap == 40 else 80)
        counted.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"passes-{cap}")))
    spark.sparkContext.setJobGroup("others", "")
    assert abs(counted[0] - counted[1]) <= 2


def test_sweep_equals_a_cascade_at_every_threshold(spark):
    rng = np.random.default_rng(9)
    docs = rng.normal(size=(80, 4))
    docs[20:30] = docs[3]  # equal scores
    tiered = materialize(frame(spark, docs, "doc_id").withColumn("tier", (F.col("doc_id") % 3 + 1).cast("int")), "tiered")
    queries = frame(spark, rng.normal(size=(12, 4)), "query_id")
    points = materialize(sweep.quality_at_every_threshold(tiered, queries, 4, 0.2), "points")
    rows = {r["threshold"]: r for r in points.collect()}
    some = sorted(rows)[:: max(1, len(rows) // 12)]
    between = [t - 1e-7 for t in some[1:]]
    for thresholds, found in ((some, rows), (between, {r["threshold"]: r for r in sweep.quality_at(points, between).collect()})):
        hits = retrieval.cascade_sweep(tiered, queries, 4, [float(t) for t in thresholds]).collect()
        for t in thresholds:
            mine = [h for h in hits if h["threshold"] == t]
            assert found[t]["total_hits"] == len(mine) and found[t]["avg_results"] == pytest.approx(len(mine) / 12)
            assert found[t]["avg_similarity"] == pytest.approx(sum(h["score"] for h in mine) / len(mine))
            for tier in (1, 2, 3):
                assert found[t][f"t{tier}_pct"] == pytest.approx(100 * sum(h["tier"] == tier for h in mine) / len(mine))
    assert sweep.quality_at_every_threshold(tiered, queries.where("query_id < 0"), 4, 0.2).count() == 0
