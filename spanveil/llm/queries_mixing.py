"""Query op2 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.mixing import mix_sources
from spanveil.storage import table


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"), cap=3.0, weights=(1, 2, 3), seed=1)
    return mix.select("doc_id", "size", "source_size", "target", "taken")
