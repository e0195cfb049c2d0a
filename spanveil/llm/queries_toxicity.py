"""Query op3 over ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.toxicity import Lexicon, learn_lexicon, score_toxicity
from spanveil.storage import table

THRESHOLD = 0.3


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(spark: SparkSession, sf_dir: str) -> Lexicon:
    """Learned from the labelled documents that aren't held out."""
    return learn_lexicon(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    scored = score_toxicity(docs, learned(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
