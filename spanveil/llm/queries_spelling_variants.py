"""Query op12 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.spelling_variants import spelling_variants
from spanveil.storage import spread, table


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(spread(table(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
