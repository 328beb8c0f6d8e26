"""Exact ranks without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from thermocline.llm.common import store

BLOCK_ROWS = 1_000_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(rows: DataFrame, order: list[str], name: str, group: str | None = None, descending: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their place (from 1) in ``order`` within ``group`` as column ``name``.

    Rows are dealt into sorted ranges; a rank is the group's rows in earlier
    ranges plus the place in the own range. A tie number splits rows that are equal in all of
    ``order``, so no value fills a range however often it occurs; which of them comes first is left open.
    ``rows`` is read twice (ranges are sampled): pass a stored table.
    """
    tie, block, at, before = fresh(rows, "_tie", "_block", "_at", "_before")
    keys = [group] if group else []
    sort = [F.col(c) for c in keys] + [F.desc(c) if c in descending else F.asc(c) for c in order]
    blocks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK_ROWS))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = store(
        rows.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(blocks, *sort, F.col(tie)).sortWithinPartitions(*sort)
        .withColumn(block, F.spark_partition_id()).withColumn(at, inside).drop(tie), "ranges")
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and group in it: ranges are consecutive, so ranges plus groups bound them.
    counted = (placed.groupBy(block, *keys).agg(F.count("*").alias(before), F.min(at).alias(tie))
               .select(block, *keys, (F.coalesce(F.sum(before).over(earlier), F.lit(0)) - F.col(tie) + 1).alias(before)))
    return placed.join(counted, [block, *keys]).withColumn(name, F.col(at) + F.col(before)).drop(block, at, before)
