"""Rate limits and stored sessions on streams: keyed state that timers remove.

Answers are the batch operators' (``rate_limited``, ``replayed_store``) as long as a
key's events come in their order; within a trigger they are put in order. Events
behind the watermark are dropped by Spark before they get here. State is in the
state store, so it outlives executors; the session needs Spark's RocksDB store
(``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanveil.operators.sessions import store_step

_STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> SparkSession:
    """``spark`` with the state store that keyed state with timers needs."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _Keyed(StatefulProcessor):
    """One value for each key, removed by a timer at its end; events of a key are handled in order."""

    kind = "until LONG, hits LONG"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.kind)

    def close(self) -> None:
        pass

    def keep(self, until: int | None, hits: int = 0) -> None:
        """The state from now on; a timer ends it a millisecond after ``until``."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if until is None:
            self.value.clear()
        else:
            self.value.update((until, hits))
            self.handle.registerTimer(until // 1000 + 1)

    def held(self) -> tuple[int | None, int]:
        return tuple(self.value.get()) if self.value.exists() else (None, 0)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        yield from ()


class _RateLimit(_Keyed):
    def __init__(self, limit: int, seconds: int):
        self.limit, self.window = limit, seconds * 1_000_000

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["us", "event_id"])  # a key's events of one trigger
        until, hits = self.held()
        counts = []
        for us in events["us"]:
            if until is None or us > until:
                until, hits = int(us) + self.window, 0
            hits += 1
            counts.append(hits)
        self.keep(until, hits)
        yield pd.DataFrame({"event_id": events["event_id"], "key": key[0], "ts": events["ts"], "hits": counts, "allowed": [h <= self.limit for h in counts]})


def rate_limit_stream(events: DataFrame, key: str, ts: str, event_id: str, limit: int = 100, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(event_id, key, ts, hits, allowed) as ``rate_limited``, for each event as it comes."""
    stamp = F.col(ts).cast("timestamp")
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(event_id).alias("event_id"), F.col(key).alias("key"), stamp.alias("ts"), F.unix_micros(stamp).alias("us"))
    schema = f"event_id {rows.schema['event_id'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, ts timestamp, hits long, allowed boolean"
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_RateLimit(limit, seconds), schema, "Append", "EventTime")


class _Store(_Keyed):
    def __init__(self, minutes: int):
        self.refresh = minutes * 60_000_000

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        actions = pd.concat(list(rows)).sort_values(["us", "action_id"])
        until, _ = self.held()
        status, ends = [], []
        for us, action, ttl in zip(actions["us"], actions["action"], actions["ttl"], strict=True):
            until, answer = store_step(until, action, int(us), None if pd.isna(ttl) else int(ttl), self.refresh)
            status.append(answer)
            ends.append(None if until is None else pd.Timestamp(until, unit="us"))
        self.keep(until)
        yield pd.DataFrame({"session_id": key[0], "ts": actions["ts"], "action_id": actions["action_id"], "action": actions["action"], "status": status, "expires_at": pd.Series(ends, index=actions.index, dtype="datetime64[ns]")})


def store_stream(actions: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(session_id, ts, action_id, action, status, expires_at) as ``replayed_store``: sessions that use extends and a timer purges."""
    stamp = F.col("ts").cast("timestamp")
    rows = actions.where("session_id is not null and ts is not null").select("session_id", stamp.alias("ts"), "action_id", F.upper("action").alias("action"), F.unix_micros(stamp).alias("us"), (F.col("ttl_minutes") * 60_000_000).cast("long").alias("ttl"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("session_id", "action_id")}
    schema = f"session_id {kinds['session_id']}, ts timestamp, action_id {kinds['action_id']}, action string, status string, expires_at timestamp"
    return rows.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(_Store(minutes), schema, "Append", "EventTime")
