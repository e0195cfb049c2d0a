"""Sessions that live while they are used, and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def activity_sessions(events: DataFrame, key: str, ts: str, minutes: int = 60) -> DataFrame:
    """(key, session_no, started_at, last_activity, expires_at, n_events).

    Each event extends its session to ``minutes`` after it; a later one begins another.
    """
    order = Window.partitionBy(key).orderBy(ts)
    before = F.lag(ts).over(order)
    gap = F.col(ts) > before + F.make_interval(mins=F.lit(minutes))
    numbered = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_new", F.when(before.isNull() | gap, 1).otherwise(0))
    numbered = numbered.withColumn("session_no", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    out = numbered.groupBy(key, "session_no").agg(F.min(ts).alias("started_at"), F.max(ts).alias("last_activity"), F.count(F.lit(1)).alias("n_events"))
    return out.withColumn("expires_at", F.col("last_activity") + F.make_interval(mins=F.lit(minutes)))


def rate_limited(events: DataFrame, key: str, ts: str, event_id: str, limit: int = 100, seconds: int = 60) -> DataFrame:
    """(event_id, key, ts, hits, allowed): a window opens at a key's first hit and, once over, at the next.

    Events are read in order in one pass over each sorted partition; a task keeps
    one window at a time.
    """
    micros = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until, hits = None, 0, 0
        for batch in batches:
            out = []
            for k, t in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k != now or t > until:
                    now, until, hits = k, t + micros, 0
                hits += 1
                out.append(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int64()), pa.array([h <= limit for h in out], pa.bool_())], names=["event_id", "key", "ts", "hits", "allowed"])

    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(event_id).alias("event_id"), F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    schema = f"event_id {rows.schema['event_id'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, ts timestamp, hits long, allowed boolean"
    return rows.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInArrow(run, schema)


#: What a reveal store answers: the session is there, or it isn't (any more, or never was).
FOUND, GONE = "OK", "GONE"
SAVE, GET, PURGE = "SAVE", "GET", "PURGE"


def store_step(until: int | None, action: str, us: int, ttl: int | None, refresh: int) -> tuple[int | None, str]:
    """(when the session ends, answer) after an action at ``us``; all times in microseconds.

    SAVE keeps a session for its own ``ttl``. GET finds it until then, and keeps it for
    ``refresh`` from now on, which may be less than it had. PURGE removes it.
    """
    if action == SAVE:
        return us + (refresh if ttl is None else ttl), FOUND
    if until is None or us > until:
        return None, GONE
    return (us + refresh, FOUND) if action == GET else (None, FOUND)


def replayed_store(actions: DataFrame, minutes: int = 60) -> DataFrame:
    """(session_id, ts, action_id, action, status, expires_at) of actions on stored sessions, in their order.

    ``actions``: (session_id, ts, action_id, action, ttl_minutes), action SAVE, GET or PURGE.
    One pass over each sorted partition; a task keeps one session at a time.
    """
    refresh = minutes * 60_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until = None, None
        for batch in batches:
            status, ends = [], []
            for k, us, action, ttl in zip(*(batch.column(i).to_pylist() for i in (0, 4, 3, 5)), strict=True):
                now, until = (now, until) if k == now else (k, None)
                until, answer = store_step(until, action, us, ttl, refresh)
                status.append(answer)
                ends.append(until)
            columns = [*batch.columns[:4], pa.array(status, pa.string()), pa.array(ends, pa.int64()).cast(pa.timestamp("us", "UTC"))]
            yield pa.RecordBatch.from_arrays(columns, names=["session_id", "ts", "action_id", "action", "status", "expires_at"])

    stamp = F.col("ts").cast("timestamp")
    rows = actions.where("session_id is not null and ts is not null").select("session_id", stamp.alias("ts"), "action_id", F.upper("action").alias("action"), F.unix_micros(stamp).alias("us"), (F.col("ttl_minutes") * 60_000_000).cast("long").alias("ttl"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("session_id", "action_id")}
    schema = f"session_id {kinds['session_id']}, ts timestamp, action_id {kinds['action_id']}, action string, status string, expires_at timestamp"
    return rows.repartition("session_id").sortWithinPartitions("session_id", "us", "action_id").mapInArrow(run, schema)
