"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thermocline.session import materialize, ship_package

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
"""Byte table that lower-cases A-Z and leaves every other UTF-8 byte alone."""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder the session names and read back."""
    return materialize(df, f"llm-{name}")


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``store`` that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles():
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            files = folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
            if "/thermocline/" in str(folder) and files.exists(folder):
                files.delete(folder, True)
            break


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000
"""Whole texts are wide rows: the default of 10,000 a batch costs every task tens of megabytes twice."""


def with_workers(spark: SparkSession) -> SparkSession:
    """Call before sending functions of this package to Python workers.

    Sets the session's Arrow batches to ``BATCH_ROWS`` rows unless the caller has chosen a size.
    """
    ship_package(spark)
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    return spark


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A worker function that gives freed memory back when its task ends.

    Workers serve many tasks of many stages; what the allocators hold for the
    last one would add up to what the next one needs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def fold(column: str, of: int) -> Column:
    """crc32 of a column's text form, modulo ``of``; null for null."""
    return F.crc32(F.col(column).cast("string")) % of


def text_key(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes, together a 128-bit key that is never null.

    A null differs from an empty string.
    """
    parts = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(1), *parts).alias("key_a"), F.xxhash64(F.lit(2), *parts).alias("key_b")]


def empty_as(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def with_texts(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    """The batch with other texts; ``n_chars``, where there is one, follows a text that changed."""
    place = batch.schema.get_field_index("text")
    if "n_chars" in batch.schema.names:
        old = batch.column(place).to_pylist()
        counts = [n if new == was else len(new) for n, new, was in zip(batch.column("n_chars").to_pylist(), texts, old)]
        at = batch.schema.get_field_index("n_chars")
        batch = batch.set_column(at, "n_chars", pa.array(counts, batch.schema.field(at).type))
    return batch.set_column(place, "text", pa.array(texts, pa.string()))
