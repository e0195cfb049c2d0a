"""Query op11 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.minhash_join import minhash_components
from spanveil.storage import spread, table


def op11_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_components(spread(table(spark, sf_dir, "documents")), n=5, num=85, den=100)
    return found.select("doc_id", F.col("n_ngrams").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
