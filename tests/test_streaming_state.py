"""Keyed state on streams gives what the batch operators give, and is purged in time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanveil.operators.sessions import rate_limited, replayed_store
from spanveil.streaming.state import rate_limit_stream, store_stream, with_state_store

BEGIN = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def state_spark(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    yield with_state_store(spark)
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def replayed(spark, rows, schema, folder, make, parts=4):
    """The rows of a stream that reads ``rows`` in so many triggers, in their order."""
    for k in range(parts):
        part = spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = make(spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return query, spark.read.parquet(f"{folder}/out")


def test_rate_limit(state_spark, tmp_path):
    rng, at, rows = random.Random(1), BEGIN, []
    for i in range(240):
        at += timedelta(seconds=rng.choice([0, 1, 5, 30, 90]))
        rows.append((i, rng.choice(["a", "a", "b", "c", None]), at))
    schema = "event_id long, user string, ts timestamp"
    _, out = replayed(state_spark, rows, schema, tmp_path, lambda s: rate_limit_stream(s, "user", "ts", "event_id", limit=3, seconds=60))
    batch = rate_limited(state_spark.createDataFrame(rows, schema), "user", "ts", "event_id", limit=3, seconds=60)
    mark = lambda df: sorted((r.event_id, r.key, r.ts, r.hits, r.allowed) for r in df.collect())
    assert mark(out) == mark(batch) and any(not r.allowed for r in out.collect())


SCHEMA = "session_id string, ts timestamp, action_id long, action string, ttl_minutes double"


def test_batch_store(spark):
    m = lambda x: BEGIN + timedelta(minutes=x)
    rows = [
        ("a", m(0), 1, "save", 240.0), ("a", m(100), 2, "get", None), ("a", m(160), 3, "get", None), ("a", m(221), 4, "get", None), ("a", m(222), 5, "get", None), ("a", m(230), 6, "save", None), ("a", m(290), 7, "get", None),
        ("a", m(291), 8, "purge", None), ("a", m(292), 9, "get", None), ("b", m(5), 10, "get", None), ("b", m(6), 11, "purge", None), (None, m(7), 12, "get", None), ("c", None, 13, "get", None),
    ]
    out = {r.action_id: (r.status, r.expires_at) for r in replayed_store(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {
        1: ("OK", m(240)), 2: ("OK", m(160)), 3: ("OK", m(220)), 4: ("GONE", None), 5: ("GONE", None), 6: ("OK", m(290)), 7: ("OK", m(350)), 8: ("OK", None), 9: ("GONE", None), 10: ("GONE", None), 11: ("GONE", None),
    }


def test_store_on_a_stream(state_spark, tmp_path):
    rng, at, rows = random.Random(2), BEGIN, []
    for i in range(200):
        at += timedelta(minutes=rng.choice([0, 1, 10, 40]))
        rows.append((rng.choice("abcdef"), at, i, rng.choice(["save", "get", "get", "get", "purge"]), rng.choice([None, 5.0, 120.0])))
    query, out = replayed(state_spark, rows, SCHEMA, tmp_path, lambda s: store_stream(s, 60, "5 minutes"), parts=6)
    batch = replayed_store(state_spark.createDataFrame(rows, SCHEMA), 60)
    mark = lambda df: sorted((r.action_id, r.session_id, r.ts, r.action, r.status, str(r.expires_at)) for r in df.collect())
    assert mark(out) == mark(batch) and {r.status for r in out.collect()} == {"OK", "GONE"}


def test_timers_purge_what_nobody_uses(state_spark, tmp_path):
    rows = [("old", BEGIN, 1, "save", 1.0)] + [("x", BEGIN + timedelta(hours=k), 1 + k, "save", 30.0) for k in range(1, 6)]
    query, out = replayed(state_spark, rows, SCHEMA, tmp_path, lambda s: store_stream(s, 60, "1 minute"), parts=6)
    assert out.count() == 6 and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    assert out.where(F.col("session_id") == "old").count() == 1
