"""Later choices on masked texts, their chunks, and purging of what restores them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unmasked(masked: Column, placeholder: Column, value: Column) -> Column:
    """``masked`` with a placeholder's value back in all its places."""
    return F.when(placeholder == "", masked).otherwise(F.replace(masked, placeholder, value))


def masked_more(masked: Column, value: Column, placeholder: Column) -> Column:
    """``masked`` with one more value hidden, in all its places."""
    return F.when(value == "", masked).otherwise(F.replace(masked, value, placeholder))


def chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chunk_no, chunk): a text in the pieces between single blanks, as it would be sent. Works on streams."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text), " ")).alias("chunk_no", "chunk"))


def purged(sessions: DataFrame, when: Column, mapping: str = "mapping", flag: str = "is_purged") -> DataFrame:
    """``sessions`` without the mapping of those to purge; they stay as rows, flagged."""
    gone = F.coalesce(when, F.lit(False))
    before = F.coalesce(F.col(flag), F.lit(False)) if flag in sessions.columns else F.lit(False)
    return sessions.withColumns({mapping: F.when(~gone, F.col(mapping)), flag: before | gone})
