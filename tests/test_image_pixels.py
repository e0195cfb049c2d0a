"""Pixels: files read as they were written, boxes hidden and put back."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.functions import png
from spanveil.operators.images import FILL, box_placeholders, placed, png_of, png_pixels, reveal_images, shield_images, worth_hiding


def filtered(rows, step, kinds):
    """Rows as a file has them, each with one of the filters, straight from their definition."""
    out = bytearray()
    for y, row in enumerate(rows):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for x, v in enumerate(row):
            a = int(row[x - step]) if x >= step else 0
            b = int(rows[y - 1][x]) if y else 0
            c = int(rows[y - 1][x - step]) if y and x >= step else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((int(v) - (0, a, b, (a + b) // 2, best)[kind]) % 256)
    return bytes(out)


def file_of(pixels, colour, kinds=(0,), depth=8, extra=(), parts=1):
    height, width, step = pixels.shape
    raw = zlib.compress(filtered(pixels.reshape(height, -1), step, kinds))
    cuts = [raw[k * len(raw) // parts : (k + 1) * len(raw) // parts] for k in range(parts)]
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)), *extra, *[(b"IDAT", c) for c in cuts], (b"IEND", b"")]
    return png.SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)


def noise(height, width, step, seed=1):
    smooth = np.add.outer(np.arange(height), np.arange(width))[..., None] * [3, 5, 7, 1][:step]
    return (smooth + np.random.default_rng(seed).integers(0, 60, (height, width, step))).astype(np.uint8)


@pytest.mark.parametrize("colour,step", [(0, 1), (4, 2), (2, 3), (6, 4)])
@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (4, 2, 1, 3, 0)])
def test_every_filter_and_colour(colour, step, kinds):
    pixels = noise(11, 7, step)
    out = png.decode(file_of(pixels, colour, kinds, parts=3))
    assert (out[..., :3] == (pixels[..., :1] if step < 3 else pixels[..., :3])).all()
    assert (out[..., 3] == (pixels[..., -1] if step in (2, 4) else 255)).all()
    if step != 2:
        assert (png.decode(png.encode(pixels)) == out).all()


def test_palette_and_transparent_colour():
    pixels = noise(5, 4, 1) % 3
    out = png.decode(file_of(pixels, 3, extra=[(b"PLTE", bytes([9, 8, 7, 1, 2, 3, 250, 0, 5])), (b"tRNS", b"\x80")]))
    assert (out[pixels[..., 0] == 2] == [250, 0, 5, 255]).all() and (out[pixels[..., 0] == 0] == [9, 8, 7, 128]).all()
    one = png.decode(file_of(pixels, 0, extra=[(b"tRNS", b"\0\1")]))
    assert ((one[..., 3] == 0) == (pixels[..., 0] == 1)).all()


def test_files_that_cannot_be_read(spark):
    good = png.encode(noise(6, 5, 4))
    bad = {
        "not a PNG file": b"GIF89a", "the file ends early": good[:-9], "damaged chunk IDAT": good[:50] + bytes([good[50] ^ 1]) + good[51:],
        "depth 16, colour type 0, interlacing 0 aren't read": file_of(noise(4, 4, 1), 0, depth=16), "too few or too many pixels": file_of(noise(3, 3, 4), 2),
        "no row filter 9": file_of(noise(1, 3, 1), 0).replace(b"", b""),
    }
    raw = zlib.compress(b"\x09abc")
    head = struct.pack(">IIBBBBB", 3, 1, 8, 0, 0, 0, 0)
    bad["no row filter 9"] = png.SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in [(b"IHDR", head), (b"IDAT", raw), (b"IEND", b"")])
    rows = [(reason, data) for reason, data in bad.items()] + [("not a PNG file", None), (None, good)]
    found = spark.createDataFrame(rows, "reason string, data binary").select("reason", png_pixels(F.col("data")).alias("p")).collect()
    assert [(r.reason, r.p.error) for r in found] == [(reason, reason) for reason, _ in rows]
    assert found[-1].p.rgba == noise(6, 5, 4).tobytes() and (found[-1].p.width, found[-1].p.height) == (5, 6)


def test_places():
    assert placed((10.5, 9.4, 3.5, 2), 20, 10) == (11, 9, 4, 1)
    assert placed((-5, 100, 500, 0), 20, 10) == (0, 9, 20, 1)


@pytest.fixture(scope="module")
def images(spark):
    pictures = {1: noise(150, 200, 4), 2: noise(40, 30, 3), 3: noise(9, 9, 1)}
    rows = [(i, png.encode(p)) for i, p in pictures.items()] + [(4, b"no picture"), (5, None)]
    return pictures, spark.createDataFrame(rows, "image_id long, data binary")


BOXES = [
    (1, "a", "PERSON_NAME", "Ada", None, 10.0, 10.0, 45.0, 25.0), (1, "b", "API_KEY", None, None, 80.0, 40.0, 60.0, 35.0), (1, "c", "PERSON_NAME", "ADA ", None, 30.0, 95.0, 70.0, 30.0),
    (1, "d", "PERSON_NAME", "Bob", None, 190.0, 140.0, 70.0, 30.0), (1, "e", "PERSON_NAME", None, "[PERSON_NAME_009", 20.0, 20.0, 50.0, 40.0), (1, "f", "EMAIL", "x", None, 5.0, 5.0, 0.0, 9.0),
    (2, "a", None, None, None, 0.4, 0.6, 3.0, 3.0), (4, "a", "EMAIL", None, None, 1.0, 1.0, 2.0, 2.0),
]
BOX = "image_id long, box_id string, entity_type string, value string, placeholder string, x double, y double, width double, height double"


def test_placeholders_of_boxes(spark):
    found = {(r.image_id, r.box_id): r.placeholder for r in box_placeholders(spark.createDataFrame(BOXES, BOX)).collect()}
    assert found == {
        (1, "a"): "[[PERSON_NAME_001]]", (1, "b"): "[[API_KEY_001]]", (1, "c"): "[[PERSON_NAME_001]]", (1, "d"): "[[PERSON_NAME_002]]", (1, "e"): "[[PERSON_NAME_009]]",
        (2, "a"): "[[CUSTOM_001]]", (4, "a"): "[[EMAIL_001]]",
    }
    short = spark.createDataFrame([("ab",), ("UK",), (" abc",), ("",)], "v string").select(worth_hiding(F.col("v"))).collect()
    assert [r[0] for r in short] == [False, True, True, False]


def test_shield_and_reveal_are_pixel_identical(spark, images):
    pictures, table = images
    out = {r.image_id: r for r in shield_images(table, spark.createDataFrame(BOXES, BOX), "key").collect()}
    assert len(out) == 5 and (out[1].n_boxes, out[2].n_boxes, out[3].n_boxes, out[4].n_boxes) == (5, 1, 0, None)
    assert out[4].error == out[5].error == "not a PNG file" and out[4].shielded is None and out[4].encrypted_mappings is None
    shown = png.decode(out[1].shielded)
    hidden = (shown == FILL).all(axis=2)
    assert hidden[10:35, 10:55].all() and hidden[40:75, 80:140].all() and hidden[95:125, 30:100].all() and hidden[140:150, 190:200].all()
    assert (shown[~hidden] == pictures[1][~hidden]).all()
    assert "PERSON_NAME" not in out[1].encrypted_mappings and "PERSON_NAME_002" in str(out[1].placeholders)

    sessions = spark.createDataFrame([(r.session_id, r.encrypted_mappings, 50 + i, i == 3) for i, r in out.items() if r.encrypted_mappings], "session_id string, encrypted_mappings string, expires_at long, is_purged boolean")
    asked = [("same", out[1].session_id, out[1].shielded), ("two", out[2].session_id, out[2].shielded), ("other size", out[1].session_id, out[2].shielded), ("damaged", out[1].session_id, out[1].shielded[:100]), ("purged", out[3].session_id, out[3].shielded), ("none", "shd_x", out[1].shielded)]
    responses = spark.createDataFrame(asked, "what string, session_id string, data binary")
    found = {r.what: r for r in reveal_images(responses, sessions, "key", F.lit(50)).collect()}
    assert {w: r.status for w, r in found.items()} == {"same": "OK", "two": "OK", "other size": "MISMATCH", "damaged": "UNREADABLE", "purged": "PURGED", "none": "NOT_FOUND"}
    assert (png.decode(found["same"].restored) == pictures[1]).all() and found["same"].n_restored == 5
    assert (png.decode(found["two"].restored)[..., :3] == pictures[2]).all()
    assert all(r.restored is None and r.n_restored == 0 for r in found.values() if r.status != "OK")
    late = reveal_images(responses.where("what = 'same'"), sessions, "key", F.lit(52)).collect()
    assert [r.status for r in late] == ["EXPIRED"]


def test_empty_tables(spark, images):
    _, table = images
    none = spark.createDataFrame([], BOX)
    assert shield_images(table.limit(0), none, "k").count() == 0
    assert [r.n_boxes for r in shield_images(table.where("image_id = 3"), none, "k").collect()] == [0]
    wrong = table.where("image_id = 3").select(png_of(F.col("data"), F.lit(7)).alias("p")).collect()
    assert [r.p for r in wrong] == [None]
