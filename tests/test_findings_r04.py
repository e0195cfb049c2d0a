"""Findings of round 4."""

import base64
import json

import numpy as np
from pyspark.sql import functions as F

from spanveil.functions import png
from spanveil.llm import minhash_join, queries_topk, topk_search
from spanveil.operators.images import reveal_images, shield_images
from spanveil.operators.reveal import encrypted_bytes
from spanveil.plans.queries import QUERIES
from tests.llm import helpers
from tests.llm.test_operators import duck_rows, same


def test_top_k_meets_in_rows_of_one_vector(spark, tmp_path, monkeypatch):
    """records held blocks of queries and of rows, so that a batch grew with both tables."""
    frame, kinds = type(spark.range(1)), []
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *a, **b: kinds.append([t for _, t in df.dtypes]) or run(df, *a, **b))
    rows = [(i, [float((i * p) % 11 - 5) / 8 for p in range(1, 4 + i % 3)]) for i in range(400)] + [(50, [9.0]), (7, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    helpers.saved(table.where("vec_id <> 50").coalesce(3), tmp_path, "embeddings")
    monkeypatch.setattr(topk_search, "SLOT_CELLS", 200, raising=False)
    got = topk_search.top_k(table.where("vec_id <> 50"), F.col("vec_id") % 50 == 0)
    same(got.toPandas(), duck_rows(queries_topk.SQL, embeddings=f"{tmp_path}/embeddings.parquet/*.parquet"))
    assert kinds and not [t for ts in kinds for t in ts if "array<array" in t or "array<struct" in t]
    assert topk_search.top_k(table, F.col("vec_id") == 50, k=1000).where("query_id = 50").count() == 400


def test_minhash_blocks_of_a_common_pair_of_keys(spark, monkeypatch):
    """blocks asked for the postings that documents bring along, which only the n-gram join gave."""
    made, run = [], minhash_join._block_meetings
    monkeypatch.setattr(minhash_join, "_block_meetings", lambda *a: made.append(run(*a)) or made[-1])
    monkeypatch.setattr(minhash_join, "POSTING_ROWS", 3)
    common = [f"p{k}" for k in range(80)]
    texts = [" ".join([*common[: 70 + i % 10], *(f"x{i}y{k}" for k in range(4 * (i % 5)))]) for i in range(40)]
    docs = helpers.docs(spark, texts)
    found = {r.doc_id: (r.n_ngrams, r.component_id) for r in minhash_join.minhash_components(docs, 5, 85, 100).collect()}
    assert found == helpers.linked(list(enumerate(texts)), 5, 85, 100)
    pairs = [(r.a, r.b) for r in made[0].collect()]
    assert len(pairs) == len(set(pairs)) > 0


def test_repeated_rows_take_no_room():
    """a row that repeats the one above was compressed anew when it is longer than what zlib looks back."""
    row = np.random.default_rng(1).integers(0, 256, (1, 20_000, 4), np.uint8)
    pixels = np.concatenate([row, row, row[:, ::-1], row[:, ::-1], row])
    assert len(png.encode(pixels)) < 3.1 * row.size and (png.decode(png.encode(pixels)) == pixels).all()


def test_images_meet_their_sessions_once(spark, sf):
    """images and what was under boxes were moved twice, for open and for shut sessions, and drawn images to their boxes."""
    plan = QUERIES["image_reveal"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan


def test_mapping_has_pixels_under_boxes_once(spark):
    """what boxes hide is compressed as one, as bytes if asked for; stored mappings of the earlier form are read."""
    pixels = np.tile(np.random.default_rng(3).integers(0, 256, (1, 500, 4), np.uint8), (40, 1, 1))
    table = spark.createDataFrame([(1, png.encode(pixels)), (2, png.encode(pixels[:3]))], "image_id long, data binary")
    boxes = spark.createDataFrame([(1, f"b{y}", "CUSTOM", None, None, 0.0, float(y), 500.0, 4.0) for y in range(0, 40, 4)], "image_id long, box_id string, entity_type string, value string, placeholder string, x double, y double, width double, height double")
    as_bytes = shield_images(table, boxes, "k", as_text=False)
    rows = {r.image_id: r for r in as_bytes.collect()}
    assert len(rows[1].encrypted_mappings) < 2 * 500 * 4  # the ten boxes hide the same pixels
    sessions = lambda found: found.select("session_id", "encrypted_mappings", F.lit(1).alias("expires_at"), F.lit(False).alias("is_purged"))
    crop = lambda y: base64.b64encode(png.encode(pixels[y : y + 4])).decode()
    old = json.dumps({"width": 500, "height": 40, "boxes": [{"box_id": "b", "x": 0, "y": y, "width": 500, "height": 4, "crop": crop(y)} for y in range(0, 40, 4)]})
    earlier = as_bytes.where("image_id = 1").withColumn("encrypted_mappings", F.base64(encrypted_bytes(F.lit(old), "k")))
    for found in (as_bytes, shield_images(table, boxes, "k"), earlier):
        back = {r.image_id: r for r in reveal_images(as_bytes.select("image_id", "session_id", "shielded"), sessions(found), "k", F.lit(0), "shielded").collect()}
        assert back[1].status == "OK" and back[1].n_restored == 10 and (png.decode(back[1].restored) == pixels).all()
    assert back[2].status == "NOT_FOUND" and back[2].restored is None
