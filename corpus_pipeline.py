"""A pipeline from documents to packed training sequences.

Each stage reads what the one before it has written. Toxic documents go, of equal
texts one stays, of near copies one stays, sources are mixed to target weights
(documents are left out or repeated), and what remains is packed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.exact_dedup import keep_one
from spanveil.llm.mixing import mixed_documents
from spanveil.llm.ngram_join import keep_representatives
from spanveil.llm.packing import pack_documents
from spanveil.llm.queries_toxicity import THRESHOLD, held_out
from spanveil.llm.toxicity import learn_lexicon, reject_toxic
from spanveil.storage import remove, shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that the lexicon, learned from the labelled ones, scores at the threshold or above.

    Null and empty texts score nothing and stay; so do all rows when no label can be
    learned from. Repeated rows are judged alike; other columns, whatever their names, stay.
    """
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels"), ~held_out())
    return reject_toxic(docs, lexicon, THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the largest id, ids before nulls.

    Null counts as empty, so of rows without text one stays.
    """
    return keep_one(docs, keep="max")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, 0.8): that with the smallest id.

    Rows without words, without an id, or without near copies stay.
    """
    return keep_representatives(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target wants them: left out, once or up to three times.

    Rows of a null source are a source of their own; documents without words are left
    out, since a mix of words takes none of them.
    """
    return mixed_documents(docs, cap=3.0, weights=(1, 2, 3), seed=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence; a null text is its end mark alone, repeated rows are packed each."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Learned scores, similarity links and tokenization can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; what a stage has read is deleted after it."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
