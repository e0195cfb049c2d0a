"""Query op5 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.ngram_join import ngram_components
from spanveil.storage import table


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select("doc_id", F.col("n_ngrams").alias("n_shingles"), "component_id", "class_id")
