"""Dictionaries from files, audit reports to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_terms(spark: SparkSession, path: str, tier: str = "custom") -> DataFrame:
    """(term, entity_type, tier, pack_id) from JSON, CSV or Parquet files.

    JSON is an array of {term, type} or an object {term: type}, one document in a
    file; without a type a term is a CUSTOM_TERM, and the last type of a term holds.
    """
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path).select("term", F.col("type").alias("entity_type"))
    elif path.endswith(".csv"):
        rows = spark.read.option("header", "true").csv(path).select("term", F.col("type").alias("entity_type"))
    else:
        whole = spark.read.option("wholetext", "true").text(path)
        items = F.from_json("value", "array<struct<term:string,type:string>>")
        pairs = F.transform(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: F.struct(e["key"].alias("term"), e["value"].alias("type")))
        listed = F.ltrim("value").startswith("[")
        rows = whole.select(F.posexplode(F.when(listed, items).otherwise(pairs)).alias("at", "t")).select("at", "t.term", F.col("t.type").alias("entity_type"))
        rows = rows.groupBy("term").agg(F.max_by("entity_type", "at").alias("entity_type"))
    typed = F.coalesce(F.upper("entity_type"), F.lit("CUSTOM_TERM"))
    return rows.where(F.col("term").isNotNull()).select("term", typed.alias("entity_type"), F.lit(tier).alias("tier"), F.lit(None).cast("string").alias("pack_id"))


def write_audit(audit: DataFrame, path: str, kind: str = "csv") -> None:
    """An audit report as CSV with a header, or as JSON lines."""
    writer = audit.write.mode("overwrite")
    (writer.option("header", "true").csv if kind == "csv" else writer.json)(path)
