"""Exact deduplication with a log-structured merge index of digests.

Documents are dealt to memtables by the partition that they lie in. Each memtable is
flushed as a run: its (digest, identifier that stays, count) rows, combined on the
map side, in the order of the digest, written to the shared folder as Parquet with
Bloom filters on the digest (they serve later look-ups of single digests). Levelled
compaction merges FAN runs at a time into a run of the next level, keeping one
identifier for a digest, until one run is left. Documents are looked up in that run
through a filter of its repeated digests: what the filter rules out occurs once and
is never shuffled. Hits are then verified byte by byte.

Defined cases: a null text counts as the empty text; empty texts are equal to each
other; texts may have any length; rows with a null id join their group but are kept
only if no row of the group has an id; a repeated row (same id, same text) has the
same decision each time; different texts with one digest are split by their bytes;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.repeats import look_up
from spanveil.storage import cut, remove, shared_dir

#: Rows of a memtable, about; at least two and at most so many are flushed.
MEMTABLE_ROWS, MEMTABLES = 100_000, 64
#: Runs that one compaction merges.
FAN = 4
#: Digests of a file that its Bloom filter is made for.
FILTER_DIGESTS = 100_000

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _best(keep: str):
    return F.min if keep == "min" else F.max


def write_runs(runs: DataFrame, folder: str, level: int) -> DataFrame:
    """Runs (run, digest, keep_id, n), written each in the order of its digests, as they are read back."""
    (
        runs.sortWithinPartitions("run", "digest")
        .write.partitionBy("run")
        .option("parquet.bloom.filter.enabled#digest", "true")
        .option("parquet.bloom.filter.expected.ndv#digest", str(FILTER_DIGESTS))
        .parquet(f"{folder}/level-{level}")
    )
    return runs.sparkSession.read.schema(runs.schema).parquet(f"{folder}/level-{level}")


def flush(keys: DataFrame, folder: str, memtables: int, keep: str) -> DataFrame:
    """The runs of level 0, flushed from rows (_id, digest)."""
    rows = keys.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(memtables)).cast("int"))
    return write_runs(rows.groupBy("run", "digest").agg(_best(keep)("_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), folder, 0)


def compact(runs: DataFrame, folder: str, number: int, keep: str) -> DataFrame:
    """(digest, keep_id, n): runs merged level by level until one is left; levels that are merged go."""
    level = 0
    while number > 1:
        found = runs.withColumn("run", F.floor(F.col("run") / FAN).cast("int"))
        merged = found.groupBy("run", "digest").agg(_best(keep)("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        runs = write_runs(merged, folder, level + 1)
        remove(runs.sparkSession, f"{folder}/level-{level}")
        level, number = level + 1, -(-number // FAN)
    return runs.drop("run")


def _verified(rows: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """(digest): repeated digests of rows (_text, digest) that stand for more than one text.

    Bytes are compared by the smallest and largest text of each digest, which meet
    in map-side partial aggregates, so that no task gets all texts of a digest.
    """
    hits = look_up(rows, repeated.select("digest", "n"), "digest", "n", total).where("n is not null")
    ends = hits.groupBy("digest").agg(F.min("_text").alias("low"), F.max("_text").alias("high"))
    return ends.where("low <> high").select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "min", digest: Digest = sha256) -> DataFrame:
    """One row for each row of ``docs``: (id, keep_id, group_size, kept, digest)."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/digests-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(text), F.lit(""))
    keys = cut(docs.select(F.col(id_col).alias("_id"), digest(body).alias("digest")))
    total = keys.count()
    memtables = min(max(2, -(-total // MEMTABLE_ROWS)), MEMTABLES)
    repeated = cut(compact(flush(keys, folder, memtables, keep), folder, memtables, keep).where("n > 1"))
    remove(spark, folder)
    rows = docs.select(F.col(id_col).alias("_id"), body.alias("_text"), digest(body).alias("digest"))
    clashing = cut(_verified(rows.select("_text", "digest"), repeated, total))
    if not clashing.isEmpty():  # a digest with several texts: those are the groups
        split = rows.join(clashing, "digest", "left_semi")
        groups = split.groupBy("digest", "_text").agg(_best(keep)("_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        apart = split.join(groups, ["digest", "_text"]).select("_id", "digest", "keep_id", "n")
        keys, repeated = keys.join(clashing, "digest", "left_anti"), repeated.join(clashing, "digest", "left_anti")
        found = look_up(keys, repeated, "digest", "n", total).unionByName(apart)
    else:
        found = look_up(keys, repeated, "digest", "n", total)
    once = F.col("n").isNull()
    keep_id = F.when(once, F.col("_id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        "digest",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; of repeated rows (one id, one text) any one stays.

    Only rows whose text is repeated are shuffled.
    """
    found = exact_dedup(docs, id_col, text, keep).where("group_size > 1")
    groups = cut(found.groupBy("digest").agg(F.collect_set(F.when(F.col("kept"), F.col("keep_id"))).alias("keep_ids"), F.count(F.lit(1)).alias("n")))
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), sha256(body).alias("digest"))
    met = look_up(whole, groups, "digest", "n", docs.count())
    stays = F.when(F.col("_id").isNull(), F.size("keep_ids") == 0).otherwise(F.array_contains("keep_ids", F.col("_id")))
    again = met.where(F.col("n").isNotNull() & stays).groupBy("digest", "_id").agg(F.first("_row").alias("_row"))
    return met.where("n is null").select("_row").unionByName(again.select("_row")).select("_row.*")
