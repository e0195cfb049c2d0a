"""Connected components by alternating large and small stars, in log-many joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.storage import cut


#: A task takes so many edges; so a small graph doesn't make files for every shuffle partition.
EDGES_A_TASK = 250_000


def parts_for(rows: int, rows_a_task: int) -> int:
    """Partitions that follow the number of rows."""
    return max(1, -(-rows // rows_a_task))


def cut_to_size(df: DataFrame, rows_a_task: int) -> DataFrame:
    """``df``, computed once, then read in as many partitions as its rows need (never more than it had)."""
    done = cut(df)
    return done.coalesce(parts_for(done.count(), rows_a_task))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node in ``edges`` (u, v): the smallest node that it reaches.

    Nodes without an edge don't appear; an edge from a node to itself is no edge.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(now)
    # a step makes no more edges than it reads
    parts = parts_for(seen[0], EDGES_A_TASK)
    now = now.coalesce(parts)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts))
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
