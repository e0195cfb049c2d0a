"""Reports over found entities and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(entities: DataFrame, *keys: str) -> DataFrame:
    """Entities by the given keys."""
    return entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def rollup_counts(entities: DataFrame, *keys: str) -> DataFrame:
    return entities.rollup(*keys).agg(F.count(F.lit(1)).alias("n"))


def cube_counts(entities: DataFrame, *keys: str) -> DataFrame:
    return entities.cube(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_documents(entities: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The k documents with the most entities."""
    return counts(entities, id_col).orderBy(F.desc("n"), id_col).limit(k)


def totals(documents: DataFrame, *keys: str) -> DataFrame:
    """Documents, entities and the mean and lowest privacy score, by the given keys or over all (columns n_entities, privacy_score)."""
    entities = F.coalesce(F.sum("n_entities"), F.lit(0)).cast("long").alias("n_entities")
    return documents.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), entities, F.round(F.avg("privacy_score"), 6).alias("mean_score"), F.min("privacy_score").alias("low_score"))


def percentiles(documents: DataFrame, column: str, at: tuple[float, ...] = (0.5, 0.9, 0.99), *keys: str, accuracy: int | None = None) -> DataFrame:
    """(keys, p50, p90, …) of a number by the given keys or over all.

    Exact, between neighbours where need be; the memory of a group is that of its
    distinct values. With ``accuracy`` it is bounded, and the values are near ones.
    """
    made = [F.percentile_approx(column, q, accuracy) if accuracy else F.percentile(column, F.lit(q)) for q in at]
    return documents.groupBy(*keys).agg(*[m.alias(f"p{q * 100:g}".replace(".", "_")) for m, q in zip(made, at, strict=True)])


def search(audit: DataFrame, text: str, columns: tuple[str, ...], decision: str | None = None, decision_col: str = "decision") -> DataFrame:
    """Rows with the text, in any case, in one of the columns, and the decision if one is given."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    out = audit.where(hit)
    return out.where(F.col(decision_col) == decision) if decision else out
