"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thermocline.llm import (
    ann,
    decontaminate,
    language,
    lexical,
    mixing,
    packing,
    quality,
    resample,
    secrets,
    sentences,
    sharding,
    simhash,
    warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_sharding": sharding.op2_sharding,
        "op3_packing": packing.op3_packing,
        "op4_ann": ann.op4_ann,
        "op5_sentences": sentences.op5_sentences,
        "op6_secrets": secrets.op6_secrets,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_quality": quality.op8_quality,
        "op9_language": language.op9_language,
        "op10_warc": warc.op10_warc,
        "op11_lexical": lexical.op11_lexical,
        "op12_resample": resample.op12_resample,
        "op13_mixing": mixing.op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": sharding.OP2_SQL,
        "op7_decontaminate": decontaminate.OP7_SQL,
        "op10_warc": warc.OP10_SQL,
        "op11_lexical": lexical.OP11_SQL,
        "op12_resample": resample.OP12_SQL,
        "op13_mixing": mixing.OP13_SQL,
    }
