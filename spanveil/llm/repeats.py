"""Looking rows up in an index of repeated keys, with little shuffled.

Most keys of a table occur once. A filter of the repeated ones (a bitmap of bounded
size, sent to every task) lets all other rows pass without a shuffle. Keys with very
many rows are few, by count, and meet their rows by broadcast, so that no task gets
all rows of one key; the rest meets in an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter has so many bits for each repeated key, and from so many to so many in all.
BITS_A_KEY, FILTER_BITS = 16, (1 << 18, 1 << 28)
#: A key with more rows, and more than this share of all rows, is hot; so at most 1 / HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 1000, 1e-4


def filter_of(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(_bucket, _bits): a bitmap of the keys' hashes, cut into buckets."""
    at = _place(F.col(key), bits)
    return keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def passing(rows: DataFrame, bitmap: DataFrame, key: str, bits: int) -> DataFrame:
    """``rows`` with _hit: may the key be one of the filter's?"""
    placed = rows.withColumn("_at", _place(F.col(key), bits))
    met = placed.join(F.broadcast(bitmap), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left")  # FILTER_BITS at most
    byte = F.expr("int(conv(hex(substring(_bits, int(bitmap_bit_position(_at) div 8) + 1, 1)), 16, 10))")
    bit = F.expr("int(bitmap_bit_position(_at) % 8)")
    return met.withColumn("_hit", F.coalesce(F.getbit(byte, bit) == 1, F.lit(False))).drop("_at", "_bucket", "_bits")


def look_up(rows: DataFrame, index: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``index`` by ``key``; ``count`` is the index column that tells how many rows have the key.

    Rows with a null key find nothing.
    """
    repeated = index.count()
    bits = min(max(1 << (BITS_A_KEY * repeated).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    marked = passing(rows, filter_of(index, key, bits), key, bits)
    hot = index.where(F.col(count) > max(HOT_ROWS, HOT_SHARE * total))
    hits, others = marked.where("_hit"), index.where(F.col(count) <= max(HOT_ROWS, HOT_SHARE * total))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema if f.name != key]
    missed = marked.where("not _hit").select("*", *nothing)
    by_broadcast = hits.join(F.broadcast(hot), key)  # 1 / HOT_SHARE rows at most
    by_shuffle = hits.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key, "left")
    return missed.unionByName(by_broadcast).unionByName(by_shuffle).drop("_hit")
