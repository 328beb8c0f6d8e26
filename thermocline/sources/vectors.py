"""Vector tables and JSON store requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from thermocline.functions import tiers as rules
from thermocline.operators.similarity import unit_matrix
from thermocline.session import ship_package

VECTOR_SCHEMA = "vec_id bigint, embedding array<float>, label int"


def read_vectors(spark: SparkSession, path: str, schema: str | StructType = VECTOR_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def ingest_corpus(source: DataFrame, path: str, id_column: str = "vec_id") -> None:
    """Keep id and embedding of a source table as the engine's document table."""
    source.select(F.col(id_column).alias("doc_id"), "embedding").write.mode("overwrite").parquet(path)


def normalize(vectors: DataFrame) -> DataFrame:
    """Unit vectors as float arrays, one Arrow batch at a time; zero vectors stay zero."""
    ship_package(vectors.sparkSession)
    target = StructType([
        StructField(f.name, ArrayType(FloatType()) if f.name == "embedding" else f.dataType) for f in vectors.schema
    ])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("embedding")
            unit = unit_matrix(batch.column(place), 0).astype(np.float32)
            dim = unit.shape[1]
            offsets = pa.array(np.arange(0, (len(unit) + 1) * dim, dim or 1, dtype=np.int32)[: len(unit) + 1])
            yield batch.set_column(place, "embedding", pa.ListArray.from_arrays(offsets, pa.array(unit.ravel())))

    return vectors.mapInArrow(task, target)


def parse_store_requests(raw: DataFrame, column: str = "body", cuts: tuple[float, float] = rules.TEMPERATURE_CUTS,
                         dimension: int | None = None) -> DataFrame:
    """Check JSON requests ``{doc_id, embedding, temperature}``.

    One stored vector of another length, or with a component that is not
    finite, would spoil every later search, so such requests are refused; with
    ``dimension`` unknown any length but zero passes.

    Adds the typed fields, the ``tier`` and a ``reason`` that is null for valid
    requests, so both outcomes come from one pass.
    """
    schema = "doc_id string, embedding string, temperature string, _bad string"
    parsed = raw.withColumn(
        "_r", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    )
    text = F.col("_r.doc_id")
    typed = (
        parsed.withColumn("doc_id", F.coalesce(text.try_cast("bigint"), F.when(
            text.try_cast("double") == F.floor(text.try_cast("double")), text.try_cast("double").try_cast("bigint"))))
        .withColumn("embedding", F.from_json("_r.embedding", "array<float>"))
        .withColumn("temperature", F.col("_r.temperature").try_cast("double"))
    )
    bad_vector = F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull())
    size = F.size("embedding")
    wrong_size = (size == 0) if dimension is None else (size != dimension)
    infinite = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    no_number = F.isnan("temperature") | (F.abs("temperature") == float("inf"))
    reason = (
        F.when(F.col("_r").isNull() | F.col("_r._bad").isNotNull(), "malformed")
        .when(text.isNull(), "missing doc_id")
        .when(F.col("_r.embedding").isNull(), "missing embedding")
        .when(F.col("_r.temperature").isNull(), "missing temperature")
        .when(F.col("doc_id").isNull(), "bad doc_id")
        .when(bad_vector, "bad embedding")
        .when(wrong_size, "bad dimension")
        .when(infinite, "not finite")
        .when(F.col("temperature").isNull() | no_number, "bad temperature")
    )
    return typed.withColumn("reason", reason).withColumn(
        "tier", F.when(F.col("reason").isNull(), rules.by_temperature(F.col("temperature"), cuts))
    ).drop("_r")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull())


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull())
