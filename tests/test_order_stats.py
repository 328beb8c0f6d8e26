import numpy as np
import pytest
from pyspark.sql import functions as F

from thermocline.operators.order_stats import interpolate, lower_rank, nearest_rank, order_statistics, upper_rank


def frame(spark, groups):
    rows = [(name, float(x)) for name, values in groups.items() for x in values]
    return spark.createDataFrame(rows, "g string, x double").repartition(4)


RANKS = {"p95": nearest_rank(0.95), "p99": nearest_rank(0.99), "low": lower_rank(0.75), "high": upper_rank(0.75)}


def check(rows, groups):
    assert {r["g"] for r in rows} == set(groups)
    for row in rows:
        values = np.sort(groups[row["g"]])
        n = len(values)
        assert row["n"] == n
        assert row["p95"] == values[int(n * 0.95)] and row["p99"] == values[int(n * 0.99)]
        place = (n - 1) * 0.75
        assert row["low"] == values[int(np.floor(place))] and row["high"] == values[int(np.ceil(place))]


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(0)
    return {
        "smooth": rng.normal(size=4000),
        "a third is one value": np.where(rng.random(3000) < 0.34, 5.0, rng.gamma(2.0, 3.0, 3000)),
        "heavy tail": np.exp(rng.normal(0, 12, 2500)),
        "one": np.array([3.0]),
        "two": np.array([1.0, 2.0]),
        "constant": np.full(2000, 7.0),
        "upper ties": np.concatenate([np.arange(1000.0), np.full(60, 999.0)]),
    }


@pytest.mark.parametrize("limit", [10**6, 300, 12])
def test_matches_sorted_values(spark, groups, limit):
    check(order_statistics(frame(spark, groups), ["g"], "x", RANKS, limit=limit).collect(), groups)


@pytest.mark.parametrize("limit", [10**6, 20])
def test_without_keys_and_linear_interpolation(spark, groups, limit):
    ranks = {"low": lower_rank(0.95), "high": upper_rank(0.95)}
    df = frame(spark, {"smooth": groups["smooth"]})
    row = order_statistics(df, [], "x", ranks, limit=limit).select(
        interpolate(F.col("n"), 0.95, F.col("low"), F.col("high")).alias("p95")
    ).first()
    assert row["p95"] == pytest.approx(np.percentile(groups["smooth"], 95), abs=1e-12)


def test_nulls_are_left_out_and_empty_input_gives_no_row(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0)], "g string, x double")
    assert order_statistics(df, ["g"], "x", {"m": lower_rank(0.5)}).first()["m"] == 1.0
    assert order_statistics(df.where("false"), ["g"], "x", {"m": lower_rank(0.5)}).count() == 0


@pytest.mark.parametrize("limit", [10**6, 20])
def test_large_integers_stay_exact(spark, limit):
    df = spark.range(500).selectExpr("9007199254740993 + id AS x")
    row = order_statistics(df, [], "x", {"first": lambda n: F.lit(0), "tenth": lambda n: F.lit(9)}, limit=limit).first()
    assert (row["first"], row["tenth"]) == (9007199254740993, 9007199254741002)
