"""Exact order statistics of huge, skewed groups.

``percentile`` and a sort window both pull a whole group into one task. Here a
large group is narrowed first: a quantile sketch (bounded state, partial
aggregation) proposes a value range around the wanted rank, a counting pass
fixes exactly how many rows lie below it, and this repeats until the range
holds at most ``limit`` distinct values. Only such a range is sorted. Rows are
never shuffled before that, and the answer is exact whatever the sketch said.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from thermocline.session import materialize

LIMIT = 1_000_000
_GRID = 1000  # cut points of the sketch
_ACCURACY = 20_000  # rank error of the sketch is at most rows / _ACCURACY

_ENDS = {"double": (float("-inf"), float("inf")), "long": (-(2**63), 2**63 - 1)}

Ranks = dict[str, Callable[[Column], Column]]


def nearest_rank(p: float) -> Callable[[Column], Column]:
    """Zero-based rank floor(n * p)."""
    return lambda n: F.floor(n.cast("double") * F.lit(float(p))).cast("bigint")


def lower_rank(p: float) -> Callable[[Column], Column]:
    return lambda n: F.floor((n - 1).cast("double") * F.lit(float(p))).cast("bigint")


def upper_rank(p: float) -> Callable[[Column], Column]:
    return lambda n: F.ceil((n - 1).cast("double") * F.lit(float(p))).cast("bigint")


def interpolate(n: Column, p: float, low: Column, high: Column) -> Column:
    """Linear interpolation between the values at ``lower_rank`` and ``upper_rank``."""
    place = (n - 1).cast("double") * F.lit(float(p))
    return low + (high - low) * (place - F.floor(place))


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Ranks, limit: int = LIMIT) -> DataFrame:
    """One row per group: its keys, ``n`` and one column per entry of ``ranks``.

    ``ranks`` maps an output name to a function from the group's row count to
    a zero-based rank. Values that are null or not a number are left out;
    integers stay integers. Only groups of more than ``limit`` rows are narrowed
    first; both ways are exact.
    """
    group = keys or ["_all"]
    rows = df.where(F.col(value).isNotNull())
    kind = "bigint" if isinstance(df.schema[value].dataType, IntegralType) else "double"
    rows = rows.select(*(keys or [F.lit(0).alias("_all")]), F.col(value).cast(kind).alias("v"))
    if kind == "double":
        rows = rows.where(~F.isnan("v"))
    # at most rows / limit groups are large, each of them one row here
    large = materialize(rows.groupBy(*group).count().where(F.col("count") > limit).drop("count"), "large-groups")
    if large.isEmpty():
        out = _sorted_pick(rows, group, ranks, limit)
    else:
        same = lambda other: reduce(lambda x, y: x & y, [rows[c].eqNullSafe(other[c]) for c in group])
        small = _sorted_pick(rows.join(large, same(large), "left_anti"), group, ranks, limit)
        # a label that is never null stands for the keys while ranges are narrowed
        label = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("_key")
        many = rows.join(large, same(large), "left_semi").select(label, "v")
        found = _narrowed_pick(many, ["_key"], ranks, limit).join(large.select(*group, label), "_key")
        out = small.unionByName(found.select(*small.columns))
    return out if keys else out.drop("_all")


def row_ranks(rows: DataFrame, by: str) -> DataFrame:
    """Adds ``_rank``: the place of every row, from 0, in the order of ``by`` (nulls first).

    Rows are range-partitioned by value and a hash of the whole row, so copies of a
    value spread too; a rank is the rows of earlier partitions plus the place within.
    """
    tie = F.xxhash64(*rows.columns)
    cut = materialize(
        rows.withColumn("_tie", tie).repartitionByRange(F.col(by).asc_nulls_first(), F.col("_tie"))
        .withColumn("_part", F.spark_partition_id()), "ranges")
    # one row per partition
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = cut.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(F.col(by).asc_nulls_first(), "_tie"))
    return cut.join(F.broadcast(parts), "_part").withColumn("_rank", F.col("_before") + place - 1).drop("_part", "_before", "_tie")


def _sorted_pick(rows: DataFrame, group: list[str], ranks: Ranks, limit: int) -> DataFrame:
    """Groups of at most ``limit`` rows: running counts over their distinct values."""
    counted = rows.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("c"))
    window = W.partitionBy(*group).orderBy("v")
    placed = counted.withColumn("upto", F.sum("c").over(window.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "n", F.sum("c").over(window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    )
    picks = []
    for name, rank in ranks.items():
        wanted = rank(F.col("n"))
        holds = (F.col("upto") - F.col("c") <= wanted) & (wanted < F.col("upto"))
        picks.append(F.max(F.when(holds, F.col("v"))).alias(name))
    return placed.groupBy(*group).agg(F.max("n").alias("n"), *picks)


def _sketch() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("held"),
        F.approx_count_distinct("v").alias("held_values"),
        F.percentile_approx("v", [i / _GRID for i in range(_GRID + 1)], _ACCURACY).alias("cuts"),
    ]


def _narrowed_pick(rows: DataFrame, group: list[str], ranks: Ranks, limit: int) -> DataFrame:
    lowest, highest = _ENDS[rows.schema["v"].dataType.typeName()]
    wanted = F.array(*[
        F.struct(F.lit(name).alias("pick"), rank(F.col("held")).alias("rank")) for name, rank in ranks.items()
    ])
    # one value range [lo, hi] per (group, wanted rank), at first the whole line;
    # "below" is the exact number of rows under lo
    ranges = rows.groupBy(*group).agg(*_sketch()).select(
        *group, F.col("held").alias("n"), "held", "held_values", "cuts",
        F.lit(lowest).alias("lo"), F.lit(highest).alias("hi"),
        F.lit(0).cast("bigint").alias("below"), F.inline(wanted),
    )
    ranges = materialize(ranges, "value-ranges")
    # a range is done when few rows, or few distinct values, are left in it
    wide = (F.col("held") > limit) & (F.col("lo") < F.col("hi"))
    before = None
    while True:
        wide_rows = ranges.where(wide & (F.col("held_values") > limit)).agg(F.sum("held")).first()[0]
        if not wide_rows or (before is not None and wide_rows >= before):  # done, or nothing left to gain
            break
        before = wide_rows
        ranges = materialize(_narrow(rows, ranges, group), "value-ranges")
        if ranges.where(wide).isEmpty():
            break
        sketched = _inside(rows, ranges, group).groupBy(*group, "pick").agg(*_sketch())
        ranges = materialize(ranges.drop("held").join(sketched, [*group, "pick"]), "value-ranges")
    counted = _inside(rows, ranges, group).groupBy(*group, "pick", "v").agg(
        F.count(F.lit(1)).alias("c"), F.first("rank").alias("rank"), F.first("n").alias("n"),
        F.first("below").alias("below"),
    )
    window = W.partitionBy(*group, "pick").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("below") + F.sum("c").over(window)
    hit = counted.withColumn("upto", upto).where(
        (F.col("upto") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("upto"))
    )
    return hit.groupBy(*group).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("pick") == name, F.col("v"))).alias(name) for name in ranks]
    )


def _inside(rows: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """Rows within each range. Ranges are a handful per group, rows are not moved for them when they are small."""
    carried = [c for c in ranges.columns if c not in (*group, "held", "held_values", "cuts")]
    per_group = ranges.groupBy(*group).agg(F.collect_list(F.struct(*carried)).alias("ranges"))
    return rows.join(per_group, group).select(*group, "v", F.inline("ranges")).where(
        (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    )


def _narrow(rows: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """Move each range to the sketch cuts around its rank, with exact counts below."""
    cell = F.floor((F.col("rank") - F.col("below")) / F.col("held") * _GRID).cast("int")
    low, high = F.element_at("cuts", F.greatest(cell, F.lit(1))), F.element_at("cuts", F.least(cell + 3, F.lit(_GRID + 1)))
    if rows.schema["v"].dataType.typeName() == "long":  # the sketch works on doubles: allow for their rounding
        low, high = low - F.ceil(F.abs(low) / F.lit(2.0**52)), high + F.ceil(F.abs(high) / F.lit(2.0**52))
    proposed = ranges.withColumn("new_lo", F.greatest("lo", low)).withColumn("new_hi", F.least("hi", high))
    number = lambda condition: F.sum(condition.cast("bigint"))
    counts = _inside(rows, proposed, group).groupBy(*group, "pick").agg(
        number(F.col("v") < F.col("new_lo")).alias("under_lo"),
        number(F.col("v") < F.col("new_hi")).alias("under_hi"),
        number(F.col("v") <= F.col("new_hi")).alias("upto_hi"),
    )
    # where a proposal misses its rank, the side that holds it is kept instead
    place = F.col("rank") - F.col("below")
    misses_low, misses_high = place < F.col("under_lo"), place >= F.col("upto_hi")
    return proposed.join(counts, [*group, "pick"]).select(
        *group, "pick", "rank", "n",
        F.when(misses_low, F.col("lo")).when(misses_high, F.col("new_hi")).otherwise(F.col("new_lo")).alias("lo"),
        F.when(misses_low, F.col("new_lo")).when(misses_high, F.col("hi")).otherwise(F.col("new_hi")).alias("hi"),
        (F.col("below") + F.when(misses_low, F.lit(0)).when(misses_high, F.col("under_hi"))
         .otherwise(F.col("under_lo"))).alias("below"),
        F.when(misses_low | misses_high, F.col("held")).otherwise(F.col("upto_hi") - F.col("under_lo")).alias("held"),
    )
