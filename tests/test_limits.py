"""Both sides of former size limits, and values that are no numbers."""

import pytest
from pyspark.sql import functions as F

from thermocline.functions import tiers as rules
from thermocline.operators import migration, tier_table
from thermocline.operators.order_stats import lower_rank, order_statistics
from thermocline.session import scratch_path


@pytest.mark.parametrize("limit", [1, 2, 10**6])
def test_no_number_is_left_out_whatever_the_size(spark, limit):
    nan = float("nan")
    rows = [("a", x) for x in (1.0, 2.0, nan, 3.0, None, nan)] + [("b", 5.0), ("c", nan)] + [(None, 7.0), (None, 8.0)]
    found = order_statistics(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"top": lower_rank(1.0)}, limit=limit)
    assert {r["g"]: (r["n"], r["top"]) for r in found.collect()} == {"a": (3, 3.0), "b": (1, 5.0), None: (2, 8.0)}


def test_what_is_no_number_is_cold(spark):
    rows = [(float("nan"),), (0.95,), (0.75,), (None,), (float("inf"),)]
    tiers = [r[0] for r in spark.createDataFrame(rows, "t double").select(rules.by_temperature(F.col("t"))).collect()]
    assert tiers == [3, 1, 2, 3, 1]


def test_a_tier_rebuilt_to_nothing_and_deleted_documents_stay_away(spark):
    schema = "doc_id bigint, tier int"
    stored = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], schema)
    path = scratch_path(spark, "tiers")
    tier_table.save_tiers(stored, path)
    left = lambda: sorted(map(tuple, tier_table.load_tiers(spark, path, stored.schema).collect()))
    tier_table.rebuild_tier(spark, path, stored.where("false"), 2)
    assert left() == [(1, 1), (2, 1), (4, 3)]
    tier_table.delete_documents(spark, path, stored.schema, spark.createDataFrame([(1,), (4,), (9,)], "doc_id bigint"))
    assert left() == [(2, 1)]


def test_the_latest_request_for_a_document_counts(spark):
    tiers = spark.createDataFrame([(1, 1, 0), (2, 3, 1)], "doc_id bigint, tier int, seq bigint")
    asked = spark.createDataFrame([(1, 3, 0), (1, 2, 5), (2, 1, 1)], "doc_id bigint, target_tier int, seq bigint")
    outcome, log, new = migration.force_migration(tiers, asked, F.lit("2024-01-31").cast("timestamp_ntz"))
    assert {(r["doc_id"], r["tier"]) for r in new.collect()} == {(1, 2), (2, 1)} and outcome.count() == 2
    moves = [tuple(r)[:2] + tuple(r)[3:] for r in migration.migration_moves(log).orderBy("doc_id", "move").collect()]
    assert moves == [(1, 1, 1, 2), (2, 1, 3, 2), (2, 2, 2, 1)]
