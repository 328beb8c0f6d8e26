"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a
DataFrame that is written as Parquet before the next stage reads it. All but the last return the
columns of ``docs``. Null ids, null and empty texts, repeated rows, extra columns and empty tables
are treated as each operator's module states:

* language ID drops texts without a letter and texts that fit no mixture of the known languages better than chance;
* near-dedup keeps the smallest doc_id of each group of texts that share four fifths of their five-word shingles;
* decontamination cuts benchmark passages out of the texts;
* the secret scan masks secrets in the texts;
* packing returns one row per piece with its place in a sequence.

Where a text changes, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermocline.llm import decontaminate, language, packing, secrets, simhash
from thermocline.llm.common import read_table, store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.learn(language.training_rows(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_phrases(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

# Fingerprints, mixture inference and token ids are outside SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = store(docs, f"stage-{number}")
    return docs
