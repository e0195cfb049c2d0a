"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a token budget (its target). Whole epochs of the source come
first; what is left of the budget goes to documents in the order of exponential
keys ``-ln(u) / weight``, where u is a hash of the document's identifier, text and
seed and the weight is the document's quality. The order within a source is cut into
buckets of the key, so that no source, however large, is sorted in one task:
bucket sums give each bucket its offset and a running sum inside the bucket the
rest. All of it is DataFrame expressions.

Defined cases: a null text has size 0; rows of a null source form a source of
their own, ordered last; documents of size 0 are taken 0 times; rows of one id, or with
none, have keys of their own if their texts differ; repeated rows (same id, text
and source) have the same key and follow one another, so that reruns agree; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.storage import cut

#: Words are runs of anything but the six white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: A source's key order is cut into parts of about so many rows, if all rows are the source's; a part is what one task sorts.
PART_ROWS = 10_000
#: What ``quality_weight`` gives at least.
LEAST_WEIGHT = 0.5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.5 to 1.5 by the share of letters and spaces in the text."""
    plain = F.regexp_count(text, F.lit(r"[\p{L}\x20]"))
    return F.lit(LEAST_WEIGHT) + F.coalesce(plain / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def source_targets(sizes: DataFrame, cap: float, weights: list[float]) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The total is shared by weight; a target stops at ``cap`` times its source and
    the excess goes to the others by weight. That is the level L at which the sum
    of min(cap * size, L * weight) is the total: sources are filled in the order of
    cap * size / weight, and the first that L doesn't fill ends the search. Windows
    here run over one row for each source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", w.cast("double").alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    by_fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = ranked.withColumn("level", rest / F.sum("w").over(after))
    first_open = F.first(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level")), ignorenulls=True)
    open_level = first_open.over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return level.select(
        "source", "source_size", F.least("most", F.coalesce(open_level * F.col("w"), F.col("most"))).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cap: float = 3.0,
    weights: tuple[float, ...] = (1, 2, 3),
    seed: int = 1,
) -> DataFrame:
    """(id, source, size, source_size, target, epochs, key, tag, taken), one row for each row; tag tells id and text.

    ``taken`` counts words with repeats: ``epochs`` whole passes and, for documents
    in the fractional pass, the words that the budget still holds, which is the
    whole document for all but the last.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    tag = F.xxhash64(F.col(id_col), F.col(text), F.lit(seed))
    u = (F.pmod(tag, F.lit(2**52)) + 0.5) / float(2**52)
    parts_of_key = max(1, -(-docs.count() // PART_ROWS))
    drawn = docs.select(F.col(id_col).alias("_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), tag.alias("tag"), (-F.log(u) / quality_weight(body)).alias("key"))
    # rows that are equal in all of this are counted, and are rows again at the end
    alike = drawn.groupBy("_id", "source", "size", "tag", "key").agg(F.count(F.lit(1)).alias("rows"))
    # at the least weight this is even; at the largest a bucket has three times its share at most
    keyed = cut(alike.withColumn("bucket", F.floor((1 - F.exp(-LEAST_WEIGHT * F.col("key"))) * parts_of_key).cast("int")))
    parts = keyed.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), cap, list(map(float, weights)))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source", "bucket", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_start"))
    t, o = targets.alias("t"), offsets.alias("o")
    plan = o.join(t, F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.*", "t.source_size", "t.target")
    k, p = keyed.alias("k"), plan.alias("p")
    rows = k.join(p, F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.bucket") == F.col("p.bucket")))
    rows = rows.select("k.*", "p.part_start", "p.source_size", "p.target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "tag", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("part_start") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0)))
    rows = _each(rows)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    budget = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.greatest(F.least(budget - F.col("start"), F.col("size")), F.lit(0))
    return rows.select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target", "epochs", "key", "tag",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
    )


def _each(rows: DataFrame) -> DataFrame:
    """Counted rows as rows, each with its own start; many equal ones are dealt out in portions first."""
    many = F.col("rows") > PART_ROWS
    single = rows.where(~many)
    portions = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PART_ROWS)))
    dealt = rows.where(many).withColumn("_p", portions).repartition("tag", "_p")
    dealt = dealt.withColumns({"start": F.col("start") + F.col("_p") * PART_ROWS * F.col("size"), "rows": F.least(F.lit(PART_ROWS).cast("long"), F.col("rows") - F.col("_p") * PART_ROWS)}).drop("_p")
    every = single.unionByName(dealt).withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    return every.withColumn("start", F.col("start") + F.col("_n") * F.col("size")).drop("_n", "rows")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    A document in the fractional pass counts as taken if at least half of its words
    are; so a source misses its target by half a document at most. Documents
    without words are not taken. Repeated rows (same id and text) are taken alike.
    """
    mix = mix_sources(docs, id_col, **options)
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    plan = mix.select(F.col("tag").alias("_pick"), copies.alias("_copies")).groupBy("_pick").agg(F.max("_copies").alias("_copies")).where("_copies > 0")
    seed, text = options.get("seed", 1), options.get("text", "text")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.col(id_col), F.col(text), F.lit(seed)).alias("_tag"))
    picked = whole.join(plan, whole["_tag"] == plan["_pick"])
    return picked.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")
