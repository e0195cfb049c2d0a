"""Query op13 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.periodic_runs import periodic_runs, repeated_words
from spanveil.storage import spread, table


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spread(table(spark, sf_dir, "documents")), change=repeated_words, texts=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
