"""Capped migration until stable, in a fixed number of jobs.

A pass moves the first ``cap`` waiting documents in registration order by one
step. A document that needs two steps stays at the front after its first, so it takes its second in the
next pass: documents start in order, and a pass starts as many as carried-over ones leave room for. With ``S(p)`` documents
started before pass ``p`` (from 0) and ``t(x)`` two-step documents among the first ``x``,

    S(p + 1) = (p + 1) * cap - t(S(p)).

Waiting documents get their place by range-partitioned ranks. The recursion needs one bit per document, whether it takes two steps: one task walks
over these bits block by block and gives each block the passes that start in it, then blocks are numbered in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.operators.order_stats import row_ranks
from thermocline.session import materialize, ship_package

BLOCK = 1 << 16  # documents


def _walk_blocks(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """For every block of two-step flags, in order: the pass its first document belongs to, and where passes start in it."""
    number, start = 0, 0  # the pass being looked at starts at this place
    first, two_before = 0, 0  # place of the block's first document, two-step documents before it
    for batch in batches:
        for block, flags, n in zip(*(batch.column(c).to_pylist() for c in ("block", "flags", "n"))):
            bits = np.unpackbits(np.frombuffer(flags, np.uint8), count=n)
            before = two_before + np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
            base = number - 1 if start > first else number  # the pass under way at the first document
            starts = []
            while start < first + n:
                starts.append(start - first)
                start, number = (number + 1) * cap - int(before[start - first]), number + 1
            yield pa.RecordBatch.from_pylist(
                [{"block": block, "base": base, "starts": starts}],
                schema=pa.schema([("block", pa.int64()), ("base", pa.int64()), ("starts", pa.list_(pa.int32()))]))
            first, two_before = first + n, int(before[-1])


def first_passes(waiting: DataFrame, order: list[str], cap: int) -> DataFrame:
    """``waiting`` with ``pass``, from 1, of each document's first step; ``steps`` is 1 or 2."""
    ship_package(waiting.sparkSession)
    ranked = row_ranks(waiting.withColumn("_order", F.struct(*order)), "_order").drop("_order")
    ranked = materialize(ranked.withColumn("_block", F.expr(f"_rank div {BLOCK}")).withColumn(
        "_at", (F.col("_rank") % BLOCK).cast("int")), "ranked-waiting").drop("_rank")

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(table.num_rows, np.uint8)
        flags[table["_at"].to_numpy()] = table["two"].to_numpy()
        return pa.table({"block": table["_block"].slice(0, 1), "n": [table.num_rows], "flags": [np.packbits(flags).tobytes()]})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walk_blocks(batches, cap)

    flags = ranked.select("_block", "_at", (F.col("steps") == 2).cast("tinyint").alias("two")).groupBy("_block").applyInArrow(
        pack, "block long, n long, flags binary")
    # all of it: one bit per waiting document
    starts = materialize(flags.repartition(1).sortWithinPartitions("block").mapInArrow(
        walk, "block long, base long, starts array<int>"), "pass-starts")

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["_row"]).append_column("pass", pa.array([], pa.int64()))
        begins, base = right["starts"][0].values.to_numpy(), right["base"][0].as_py()
        at = left["_at"].to_numpy()
        ahead = int(len(begins) == 0 or begins[0] > 0)  # a pass of an earlier block is under way
        passes = base + np.searchsorted(begins, at, side="right") - 1 + ahead
        return left.select(["_row"]).append_column("pass", pa.array(passes + 1))

    # a block's rows travel as one struct column, so their names and types stay as they are
    rest = [c for c in ranked.columns if c not in ("_block", "_at")]
    packed = ranked.select("_block", "_at", F.struct(*rest).alias("_row"))
    row = packed.schema["_row"].dataType.simpleString()
    numbered = packed.groupBy("_block").cogroup(starts.groupBy("block")).applyInArrow(number, f"_row {row}, pass long")
    return numbered.select("_row.*", F.col("pass").cast("int").alias("pass"))
