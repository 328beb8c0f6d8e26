"""Which table plays which role when the operators run over the shared test tables.

Documents are all vectors of ``embeddings``. A vector whose id occurs in the
``events`` access log is a workload query; all other vectors are the held-out
queries. Texts and titles come from ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.functions import tiers as rules
from thermocline.operators import inverted_file
from thermocline.operators.access import access_scores, access_stats
from thermocline.operators.inverted_file import InvertedFile
from thermocline.plans.lifecycle import TierBuild, build_tiers
from thermocline.session import materialize, scratch_path
from thermocline.sources.queries import HELD_OUT, WORKLOAD, split_queries
from thermocline.sources.vectors import read_vectors

AS_OF = "2024-01-31 00:00:00"
K = 5
DIMENSION = 64
THRESHOLD = 0.25
THRESHOLDS = [0.2, 0.25, 0.3]
NEAR = 0.99
ARRIVALS = (1, 9, 17, 25, 32)  # days of the month: files of the access log that arrive one after another
CELLS, CODE_BYTES, INDEX_BLOCK = 16, 16, 64
BASELINE, TIERED = "view", "click"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_vectors(spark, f"{sf_dir}/embeddings.parquet")


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding")


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), "ts")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, embedding, split)``"""
    asked = vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    return split_queries(asked, accesses(spark, sf_dir).select(F.col("doc_id").alias("query_id")))


_query_tables: dict[tuple[str, str], DataFrame] = {}


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query sets as a stored table partitioned by split, written on first use in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _query_tables:
        _query_tables[key] = materialize(all_queries(spark, sf_dir), "queries", partition_by="split")
    return _query_tables[key]


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_table(spark, sf_dir).where(F.col("split") == WORKLOAD).drop("split")


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_table(spark, sf_dir).where(F.col("split") == HELD_OUT).drop("split")


def scaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are not normalised: each times its label, so label 0 gives zero vectors."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    return vectors(spark, sf_dir).withColumn("embedding", scaled)


_builds: dict[tuple[str, str], TierBuild] = {}


def fresh_build(spark: SparkSession, sf_dir: str) -> TierBuild:
    return build_tiers(doc_vectors(spark, sf_dir), workload(spark, sf_dir), scratch_path(spark, "tiers"))


def tier_build(spark: SparkSession, sf_dir: str) -> TierBuild:
    """The build of this application, made on first use and read from its stored table afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _builds:
        _builds[key] = fresh_build(spark, sf_dir)
    return _builds[key]


def tiered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_build(spark, sf_dir).tiered


_indexes: dict[tuple[str, str], InvertedFile] = {}


def indexed(spark: SparkSession, sf_dir: str) -> InvertedFile:
    """The inverted file over the tier table, with codes, built on first use in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = inverted_file.build(
            tiered_docs(spark, sf_dir), scratch_path(spark, "inverted"), CELLS, CODE_BYTES, INDEX_BLOCK)
    return _indexes[key]


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as documents, and next to them a changed copy of every held-out query under its negative id."""
    plain = doc_vectors(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>"))
    change = F.transform("embedding", lambda x, i: x.cast("double") * ((i + F.col("query_id")) % 5 * 0.02 + 0.96))
    copies = held_out(spark, sf_dir).select((-F.col("query_id") - 1).alias("doc_id"), change.alias("embedding"))
    return plain.unionByName(copies)


def doc_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), "text")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))


def current_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier map of the migration keys, in registration order."""
    spread = (F.col("vec_id") % 3 + 1).cast("int")
    return vectors(spark, sf_dir).select(
        F.col("vec_id").alias("doc_id"), spread.alias("tier"), F.col("vec_id").alias("seq")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_scores(access_stats(accesses(spark, sf_dir), AS_OF), AS_OF)


def event_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event stores its document again, with a 0..1 temperature taken from the event's value."""
    temperature = F.least(F.col("value") / 100.0, F.lit(1.0))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), rules.by_temperature(temperature).alias("tier"), F.col("event_id").alias("seq")
    )


def initial_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier map as registrations older than every event."""
    return current_tiers(spark, sf_dir).withColumn("seq", F.col("seq") - F.lit(10**12))


def latency_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(*[F.lit(t) for t in THRESHOLDS])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"), F.col("value").alias("latency_ms"), F.col("event_type").alias("system"),
        F.element_at(levels, (F.col("user_id") % 3 + 1).cast("int")).alias("threshold"),
    )


def forced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per document; targets 0 and 4 do not exist, documents without a vector are unknown."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 5).cast("int").alias("target_tier"))


def store_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON store requests from the vectors; eight labels carry a defect each."""
    whole = F.to_json(F.struct(F.col("vec_id").alias("doc_id"), "embedding", (F.col("label") / 9.0).alias("temperature")))
    no_temperature = F.to_json(F.struct(F.col("vec_id").alias("doc_id"), "embedding"))
    wrong_type = F.to_json(
        F.struct(F.col("vec_id").alias("doc_id"), F.lit("none").alias("embedding"), F.lit(0.5).alias("temperature"))
    )
    request = lambda **parts: F.to_json(F.struct(*[x.alias(name) for name, x in {
        "doc_id": F.col("vec_id"), "embedding": F.col("embedding"), "temperature": F.col("label") / 9.0, **parts}.items()]))
    no_number = F.lit(float("nan")).cast("float")
    defects = {
        1: no_temperature, 2: F.concat(F.lit("{"), F.lit("doc_id")), 3: wrong_type,
        4: request(embedding=F.slice("embedding", 1, 0)), 5: request(doc_id=F.col("vec_id") + 0.5),
        6: request(temperature=F.lit(float("nan"))), 7: request(embedding=F.concat(F.slice("embedding", 2, 999), F.array(no_number))),
        8: request(embedding=F.slice("embedding", 2, 999)),
    }
    body = whole
    for label, wrong in defects.items():
        body = F.when(F.col("label") == label, wrong).otherwise(body)
    return vectors(spark, sf_dir).select(body.alias("body"), F.col("vec_id").alias("seq"))
