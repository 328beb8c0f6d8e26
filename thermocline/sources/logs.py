"""Latency logs as CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "query_id bigint, latency_ms double, system string"
# Fixed format of log names: query_log_<system>_th<threshold>.csv
_NAME = r"query_log_(.+?)(?:_th([0-9]+\.[0-9]+))?\.csv"


def write_query_log(log: DataFrame, path: str, system: str | None = None) -> None:
    """``(query_id, latency_ms, system)``; a given label replaces the column."""
    if system is not None:
        log = log.withColumn("system", F.lit(system))
    log.select("query_id", "latency_ms", "system").write.mode("overwrite").option("header", True).csv(path)


def stack_logs(**by_system: DataFrame) -> DataFrame:
    """Logs of several systems as one table with a ``system`` label."""
    labelled = [
        log.select("query_id", "latency_ms", *[c for c in ("threshold",) if c in log.columns], F.lit(name).alias("system"))
        for name, log in by_system.items()
    ]
    return reduce(DataFrame.unionByName, labelled)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).option("header", True).csv(path)


def write_named_logs(log: DataFrame, root: str) -> None:
    """One log per (system, threshold) below ``root``, named by both, from one job."""
    name = F.concat(F.lit("query_log_"), F.col("system"), F.lit("_th"), F.col("threshold").cast("string"), F.lit(".csv"))
    log.select("query_id", "latency_ms", "system", name.alias("log")).write.mode("overwrite").option(
        "header", True
    ).partitionBy("log").csv(root)


def read_named_logs(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """All logs below ``root`` in one scan; system and threshold come from the name of the log."""
    scan = (
        spark.read.schema(LOG_SCHEMA).option("header", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).csv(root)
    )
    path = F.col("_metadata.file_path")
    threshold = F.regexp_extract(path, _NAME, 2)
    return scan.select(
        "query_id", "latency_ms", F.regexp_extract(path, _NAME, 1).alias("system"),
        F.when(threshold != "", threshold.cast("double")).alias("threshold"),
    )
