"""Query op8 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.token_counts import count_tokens
from spanveil.storage import table


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
