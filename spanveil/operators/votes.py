"""Votes of several detectors for one place, fused into one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse_votes(votes: DataFrame, id_col: str = "doc_id", more: float = 0.03, most: float = 0.99) -> DataFrame:
    """(id, start, end, entity_type, confidence, votes) from ``votes`` (id, start, end, entity_type, confidence).

    Votes that overlap, also by way of others, are one place. A type's confidence is
    its surest vote's, and ``more`` for each further one, ``most`` at most; the surest
    type wins, of equal ones the first by name.
    """
    order = Window.partitionBy(id_col).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = votes.withColumn("_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    placed = begun.withColumn("_place", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    types = placed.groupBy(id_col, "_place", "entity_type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("top"), F.count(F.lit(1)).alias("votes"))
    score = F.least(F.lit(most), F.col("top") + more * (F.col("votes") - 1))
    best = F.min_by(F.struct("entity_type", F.round(score, 9).alias("confidence"), "votes"), F.struct(-F.round(score, 9), "entity_type"))
    places = types.groupBy(id_col, "_place").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("best"))
    return places.select(id_col, "start", "end", "best.entity_type", "best.confidence", "best.votes")
