"""Query op4 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.packing import pack_documents
from spanveil.storage import table


def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)
