"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from spanveil.plans.queries import QUERIES
from spanveil.plans.sql import SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_rate_limit_against_brute_force(spark, sf):
    rows = QUERIES["rate_limit"](spark, sf).collect()
    until, hits = {}, {}
    for r in sorted(rows, key=lambda r: (r.key, r.ts, r.event_id)):
        if r.key not in until or r.ts.timestamp() > until[r.key]:
            until[r.key], hits[r.key] = r.ts.timestamp() + 3600, 0
        hits[r.key] += 1
        assert (r.hits, r.allowed) == (hits[r.key], hits[r.key] <= 3)


def test_shield_covers_every_document(spark, sf):
    out = QUERIES["shield_documents"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
