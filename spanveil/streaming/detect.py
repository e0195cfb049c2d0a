"""Detection and masking of streams; activity sessions with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.operators.shield import shield


def shield_stream(docs: DataFrame, **options) -> DataFrame:
    """``shield`` keeps no state, so it applies to a stream as it is."""
    return shield(docs, **options)


def entity_counts_stream(found: DataFrame, ts: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, entity_type, n) of a stream with a column ``entities``."""
    rows = found.withWatermark(ts, late).select(ts, F.explode("entities").alias("e"))
    return rows.groupBy(F.window(ts, window), F.col("e.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def sessions_stream(events: DataFrame, key: str, ts: str, late: str = "10 minutes", minutes: int = 60) -> DataFrame:
    """(key, started_at, expires_at, n_events) of sessions that activity extends."""
    rows = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return rows.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("expires_at"), "n_events")
