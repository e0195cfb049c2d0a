"""Dictionaries from files, audit reports, and operators on streams."""

from pyspark.sql import functions as F

from spanveil.functions.scalars import html_escaped, html_text, luhn_valid, without_accents
from spanveil.operators.dictionary import match_terms, merged_terms, pack_terms
from spanveil.operators.geometry import clamped, iou
from spanveil.operators.sessions import activity_sessions
from spanveil.sources.files import read_terms, write_audit
from spanveil.streaming.detect import sessions_stream, shield_stream


def test_read_terms(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"term": "Alpha", "type": "product"}, {"term": "Beta"}, {"term": "Alpha", "type": "event"}]')
    (tmp_path / "map.json").write_text('{"Alpha": "PRODUCT", "Gamma": "ORGANIZATION"}')
    (tmp_path / "terms.csv").write_text("term,type\nDelta,IBAN\n")
    read = lambda name: {r.term: r.entity_type for r in read_terms(spark, str(tmp_path / name)).collect()}
    assert read("list.json") == {"Alpha": "EVENT", "Beta": "CUSTOM_TERM"}
    assert read("map.json") == {"Alpha": "PRODUCT", "Gamma": "ORGANIZATION"}
    assert read("terms.csv") == {"Delta": "IBAN"}


def test_packs_and_tiers(spark):
    docs = spark.createDataFrame([(1, "the electronic health record of RIA, not triathlon"), (2, None)], "doc_id long, text string")
    found = lambda *packs: {(r.term, r.value, r.start) for r in match_terms(docs, pack_terms(spark, packs, (("RIA", "ORGANIZATION"),))).collect()}
    assert found("HEALTHCARE_PHI") == {("Electronic Health Record", "electronic health record", 4), ("RIA", "RIA", 32)}
    assert found("FINANCE_MNPI") == {("RIA", "RIA", 32)}
    both = spark.createDataFrame([("Orion", "PRODUCT", "org", None), ("orion", "EVENT", "custom", None)], "term string, entity_type string, tier string, pack_id string")
    assert [(r.entity_type, r.tier) for r in merged_terms(both).collect()] == [("EVENT", "custom")]


def test_audit_report(spark, tmp_path):
    write_audit(spark.createDataFrame([(1, "MASKED")], "doc_id long, decision string"), str(tmp_path / "a"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "a")).collect()[0].decision == "MASKED"


def test_scalars(spark):
    row = spark.range(1).select(
        luhn_valid(F.lit("4539 1488 0343 6467")).alias("good"), luhn_valid(F.lit("4539 1488 0343 6468")).alias("bad"),
        html_escaped(F.lit("<a href='x'>/&")).alias("safe"), html_text(F.lit("<p>a<script>x</script>b</p>")).alias("bare"), without_accents(F.lit("François Müller")).alias("plain"),
    ).first()
    assert (row.good, row.bad, row.safe, row.plain) == (True, False, "&lt;a href=&#x27;x&#x27;&gt;&#x2F;&", "Francois Muller")
    assert row.bare.split() == ["a", "b"]


def test_geometry(spark):
    a, b = ({"x": F.lit(x), "y": F.lit(0.0), "width": F.lit(10.0), "height": F.lit(10.0)} for x in (0.0, 5.0))
    row = spark.range(1).select(F.round(iou(a, b), 4).alias("iou"), clamped({"x": F.lit(-5.0), "y": F.lit(95.0), "width": F.lit(50.0), "height": F.lit(50.0)}, F.lit(100.0), F.lit(100.0))["height"].alias("h")).first()
    assert (row.iou, row.h) == (0.3333, 5.0)


def test_streams(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/documents.parquet").limit(20).write.parquet(str(tmp_path / "in" / "a"))
    stream = shield_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "a")).select("doc_id", "text"))
    query = stream.select("doc_id", "masked_text").writeStream.format("memory").queryName("shielded").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("shielded").count() == 20


def test_session_stream_agrees_with_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:50:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:10:00"), (3, "2024-01-02 00:00:00")]
    events = spark.createDataFrame(rows, "user long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {(r.user, str(r.started_at), r.n_events) for r in activity_sessions(events, "user", "ts").collect()}
    events.write.parquet(str(tmp_path / "e"))
    stream = sessions_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "user", "ts")
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.user, str(r.started_at), r.n_events) for r in spark.table("sessions").collect()} == batch
