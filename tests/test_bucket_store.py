"""Changes in place: right rows, and untouched files stay as they are."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from thermocline.operators import bucket_store as bs
from thermocline.session import scratch_path

SCHEMA = "doc_id bigint, tier int, embedding array<float>, seq bigint"


@pytest.fixture()
def store(spark):
    rows = [(i, i % 3 + 1, [float(i), 1.0], 0) for i in range(200)]
    return bs.create(spark.createDataFrame(rows, SCHEMA).repartition(4), scratch_path(spark, "buckets"), 8)


def rows(spark, store, tier=None):
    return sorted((r["doc_id"], r["tier"], r["embedding"][0], r["seq"]) for r in bs.read(spark, store, tier).collect())


def files(store):
    return {str(f.relative_to(store.path)) for f in Path(store.path).rglob("*.parquet")}


def folders(names):
    return {n.rsplit("/", 1)[0] for n in names}


def test_upsert_replaces_the_copy_of_its_tier(spark, store):
    before, old = files(store), rows(spark, store)
    new = [(5, 3, [50.0, 0.0], 7), (5, 3, [51.0, 0.0], 9), (5, 1, [52.0, 0.0], 8), (999, 2, [9.0, 0.0], 1)]
    for _ in range(2):  # a repeated job changes nothing more
        bs.upsert(store, spark.createDataFrame(new, SCHEMA))
        want = [r for r in old if r[:2] != (5, 3)] + [(5, 3, 51.0, 9), (5, 1, 52.0, 8), (999, 2, 9.0, 1)]
        assert rows(spark, store) == sorted(want)
    touched = folders(files(store) - before)
    assert len(touched) == 3 and folders(before - files(store)) <= touched
    assert rows(spark, store, 2) == [r for r in sorted(want) if r[1] == 2]


@pytest.mark.parametrize("remove", [True, False])
def test_moves_take_the_vector_along(spark, store, remove):
    bs.upsert(store, spark.createDataFrame([(3, 2, [-3.0, 0.0], 4)], SCHEMA))  # an older copy where 3 moves to
    before, old = files(store), rows(spark, store)
    moves = spark.createDataFrame([(3, 1, 2), (7, 2, 3), (8, 1, 2), (5000, 1, 2)], "doc_id bigint, from_tier int, to_tier int")
    bs.move(store, moves, remove)
    want = [r for r in old if r not in ((3, 2, -3.0, 4),)] + [(3, 2, 3.0, 0), (7, 3, 7.0, 0)]
    if remove:
        want = [r for r in want if r not in ((3, 1, 3.0, 0), (7, 2, 7.0, 0))]
    assert rows(spark, store) == sorted(want)  # 8 has no copy in tier 1, 5000 none at all
    changed = folders(files(store) ^ before)
    buckets = {re.search(r"bucket=(\d+)", f)[1] for f in changed}
    assert len(buckets) <= 4 and len(changed) <= 8 and len(files(store) & before) >= 24 - 8


def test_delete_rewrites_only_tiers_that_hold_the_ids(spark, store):
    before, old = files(store), rows(spark, store)
    ids = spark.createDataFrame([(6,), (6,), (10,), (7777,), (None,)], "doc_id bigint")
    bs.delete(store, ids)
    assert rows(spark, store) == [r for r in old if r[0] not in (6, 10)]
    assert len(folders(before - files(store))) == 2
    bs.delete(store, spark.createDataFrame([(i,) for i in range(200) if i % 3 == 1], "doc_id bigint"))
    assert rows(spark, store, 2) == [] and not any(f.startswith("tier=2") for f in files(store))
    assert len(rows(spark, store)) == len([r for r in old if r[1] != 2 and r[0] not in (6,)])
    bs.move(store, spark.createDataFrame([(0, 1, 2)], "doc_id bigint, from_tier int, to_tier int"))
    assert rows(spark, store, 2) == [(0, 2, 0.0, 0)]


def test_a_change_scans_only_its_folders(spark, store):
    one = spark.createDataFrame([(5, 3)], "doc_id bigint, tier int").withColumn("bucket", bs._bucket(8))
    found = bs._folders(store, bs.materialize(one.select("tier", "bucket"), "touched"))
    found.collect()
    assert "dynamicprun" in found._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_change(spark, store):
    before = files(store)
    none = spark.createDataFrame([], SCHEMA)
    bs.upsert(store, none)
    bs.delete(store, none.select("doc_id"))
    bs.move(store, none.select("doc_id", F.col("tier").alias("from_tier"), F.col("tier").alias("to_tier")))
    assert files(store) == before
    assert bs.buckets_for(10**9, 3000) == 22352 and bs.buckets_for(0, 10) == 1
