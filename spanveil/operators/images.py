"""Boxes of images hidden and restored.

Boxes meet their images in a join on the image; pixels are worked on in Arrow
batches, one image at a time. What boxes hide is kept encrypted, and put back only on
an image of the same size. A mapping is ten digits, the length of its JSON (sizes and
boxes), and behind that the pixels of all boxes, compressed as one; mappings that were
stored as JSON alone, with a PNG file in base64 for each box, are read too.

A file that can't be read isn't an error of the job: its row has the reason.
"""

from __future__ import annotations

import base64
import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions import png
from spanveil.operators.ocr import RECT
from spanveil.operators.reveal import encrypted_bytes
from spanveil.operators.shield import session_id

#: What stands over a hidden box: red, green, blue, alpha.
FILL = (15, 23, 42, 255)
#: Values this short aren't hidden, but for these.
SHORT, SHORT_VALUES = 3, ("us", "uk", "id", "ip")
_HIDDEN = "struct<data:binary,width:int,height:int,crops:array<struct<box_id:string,x:int,y:int,width:int,height:int>>,pixels:binary,error:string>"
_RESTORED = "struct<data:binary,restored:int,error:string>"
#: Digits of the length before a mapping's JSON.
_DIGITS = 10
#: Statuses of a reveal beside those of texts.
MISMATCH, UNREADABLE = "MISMATCH", "UNREADABLE"


def placed(rect: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int]:
    """A rectangle in whole pixels inside an image, a pixel wide and high at least."""
    whole = [math.floor(v + 0.5) for v in rect]
    x, y = max(0, min(width - 1, whole[0])), max(0, min(height - 1, whole[1]))
    return x, y, max(1, min(width - x, whole[2])), max(1, min(height - y, whole[3]))


def png_of(pixels: Column, width: Column, channels: int = 1) -> Column:
    """A PNG file of rows of ``width`` pixels of one, three or four bytes; null where the bytes don't fill rows."""

    def write(data: pa.Array, widths: pa.Array) -> pa.Array:
        out = []
        for body, w in zip(data.to_pylist(), widths.to_pylist(), strict=True):
            whole = body and w and len(body) % (w * channels) == 0
            out.append(png.encode(np.frombuffer(body, np.uint8).reshape(-1, w, channels)) if whole else None)
        return pa.array(out, pa.binary())

    # what is asked for several times is written once
    return F.arrow_udf(write, "binary").asNondeterministic()(pixels, width.cast("int"))


def png_pixels(data: Column) -> Column:
    """struct<width, height, rgba, error> of a PNG file; error tells why it can't be read."""

    def read(files: pa.Array) -> pa.Array:
        out = []
        for body in files.to_pylist():
            try:
                pixels = png.decode(body or b"")
                out.append({"width": pixels.shape[1], "height": pixels.shape[0], "rgba": pixels.tobytes(), "error": None})
            except ValueError as e:
                out.append({"width": None, "height": None, "rgba": None, "error": str(e)})
        return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("error", pa.string())]))

    return F.arrow_udf(read, "struct<width:int,height:int,rgba:binary,error:string>")(data)


def box_placeholders(boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """``boxes`` (image, box_id, entity_type, value, placeholder, x, y, width, height) with every placeholder set.

    One that a box brings along stays, in double brackets. The others are numbered by
    type in the order of box_id; boxes of an image with one value, in any case, share
    the first one's. A box without value is a value of its own, as are its repeats in
    the same place. Boxes without area are left out.
    """
    given = F.regexp_replace(F.regexp_replace(F.trim("placeholder"), r"^\[*", "[["), r"\]*$", "]]")
    given = F.when(F.trim("placeholder") != "", given)
    own = F.when(F.trim("value") != "", F.concat(F.lit("v:"), F.lower(F.trim("value")))).otherwise(F.concat_ws(":", F.lit("b"), "entity_type", *RECT))
    rows = boxes.where("width > 0 and height > 0").withColumn("entity_type", F.coalesce("entity_type", F.lit("CUSTOM")))
    rows = rows.withColumns({"_given": given, "_key": F.when(given.isNull(), own)})
    same = Window.partitionBy(image, "_key")
    rows = rows.withColumns({"_first": F.min(F.struct("box_id", "entity_type")).over(same)})
    kind = F.when(F.col("_given").isNull(), F.col("_first.entity_type"))
    number = F.dense_rank().over(Window.partitionBy(image, kind).orderBy("_first.box_id"))
    # numbers are counted over boxes without a placeholder only: the others have no type there
    name = F.concat(F.lit("[["), kind, F.lit("_"), F.lpad(number.cast("string"), 3, "0"), F.lit("]]"))
    wide = F.concat(F.lit("[["), kind, F.lit("_"), number.cast("string"), F.lit("]]"))
    return rows.withColumn("placeholder", F.coalesce("_given", F.when(number > 999, wide).otherwise(name))).drop("_given", "_key", "_first")


def worth_hiding(value: Column) -> Column:
    """Is a value found by reading an image long enough to be hidden?"""
    bare = F.lower(F.trim(value))
    return (F.length(bare) >= SHORT) | bare.isin(*SHORT_VALUES)


def _hide(files: pa.Array, boxes: pa.Array) -> pa.Array:
    out = []
    for body, rects in zip(files.to_pylist(), boxes.to_pylist(), strict=True):
        try:
            pixels = png.decode(body or b"")
        except ValueError as e:
            out.append({"error": str(e)})
            continue
        height, width = pixels.shape[:2]
        shown, crops, under = pixels.copy(), [], []
        for box in rects or []:
            x, y, w, h = placed(tuple(box[n] for n in RECT), width, height)
            under.append(pixels[y : y + h, x : x + w].tobytes())
            crops.append({"box_id": box["box_id"], "x": x, "y": y, "width": w, "height": h})
            shown[y : y + h, x : x + w] = FILL
        out.append({"data": png.encode(shown), "width": width, "height": height, "crops": crops, "pixels": zlib.compress(b"".join(under), png.LEVEL)})
    crop = pa.struct([("box_id", pa.string()), *[(n, pa.int32()) for n in RECT]])
    return pa.array(out, pa.struct([("data", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("crops", pa.list_(crop)), ("pixels", pa.binary()), ("error", pa.string())]))


def shield_images(images: DataFrame, boxes: DataFrame, secret: str, image: str = "image_id", data: str | Column = "data", salt: str = "", as_text: bool = True) -> DataFrame:
    """(…images, shielded, image_width, image_height, n_boxes, placeholders, encrypted_mappings, session_id, error).

    ``boxes`` are as for ``box_placeholders``. A box that reaches over the edge is cut.
    An image without boxes stays as it is, but is written anew; one that can't be read
    has no result but its ``error``. encrypted_mappings are in base64, or bytes, which
    take a quarter less, without ``as_text``. ``data`` may be an expression of the images'
    columns: the files are then made where the boxes are, and only what they are made of
    is moved.
    """
    named = box_placeholders(boxes, image).select(image, F.struct(F.col("box_id").cast("string").alias("box_id"), "entity_type", "placeholder", *[F.col(n).cast("double").alias(n) for n in RECT]).alias("_b"))
    listed = named.groupBy(image).agg(F.array_sort(F.collect_list("_b")).alias("_boxes"))
    met = images.join(listed, image, "left").withColumn("_boxes", F.coalesce("_boxes", F.array().cast(named.select(F.array("_b")).schema[0].dataType)))
    met = met.withColumn("_data", F.col(data) if isinstance(data, str) else data)
    out = met.withColumn("_h", F.arrow_udf(_hide, _HIDDEN).asNondeterministic()(F.col("_data"), F.col("_boxes")))
    kept = F.transform(
        "_h.crops",
        lambda c, i: F.struct(c["box_id"].alias("box_id"), F.get("_boxes", i)["entity_type"].alias("entity_type"), F.get("_boxes", i)["placeholder"].alias("placeholder"), *[c[n].alias(n) for n in RECT]),
    )
    out = out.withColumn("_head", F.encode(F.to_json(F.struct(F.col("_h.width").alias("width"), F.col("_h.height").alias("height"), kept.alias("boxes"))), "UTF-8"))
    mapping = encrypted_bytes(F.concat(F.encode(F.lpad(F.length("_head").cast("string"), _DIGITS, "0"), "UTF-8"), "_head", "_h.pixels"), secret)
    read = F.col("_h.error").isNull()
    return out.withColumns(
        {
            "shielded": F.col("_h.data"),
            "image_width": F.col("_h.width"),
            "image_height": F.col("_h.height"),
            "n_boxes": F.when(read, F.size("_boxes")),
            "placeholders": F.when(read, F.array_distinct(F.transform("_boxes", lambda b: b["placeholder"]))),
            "encrypted_mappings": F.when(read, F.base64(mapping) if as_text else mapping),
            "session_id": session_id(F.col(image), F.hex(F.sha2("_data", 256)), salt),
            "error": F.col("_h.error"),
        }
    ).drop("_boxes", "_data", "_h", "_head")


def _kept(mapping: bytes) -> tuple[dict, list[np.ndarray]]:
    """The sizes and boxes of a mapping, and the pixels that were under the boxes."""
    if mapping[:1] == b"{":
        head = json.loads(mapping)
        return head, [png.decode(base64.b64decode(box["crop"])) for box in head["boxes"]]
    at = _DIGITS + int(mapping[:_DIGITS])
    head, flat = json.loads(mapping[_DIGITS:at]), np.frombuffer(zlib.decompress(mapping[at:]), np.uint8)
    shapes = [(box["height"], box["width"], 4) for box in head["boxes"]]
    parts = np.split(flat, np.cumsum([math.prod(s) for s in shapes])[:-1]) if shapes else []
    return head, [part.reshape(s) for part, s in zip(parts, shapes, strict=True)]


def _restore(files: pa.Array, mappings: pa.Array) -> pa.Array:
    out = []
    for file, mapping in zip(files, mappings, strict=True):
        if not mapping.is_valid:  # nothing is put back
            out.append({})
            continue
        head, crops = _kept(mapping.as_py())
        try:
            pixels = png.decode(file.as_py() or b"")
        except ValueError:
            out.append({"error": UNREADABLE})
            continue
        if pixels.shape[:2] != (head["height"], head["width"]):
            out.append({"error": MISMATCH})
            continue
        for box, crop in zip(head["boxes"], crops, strict=True):
            x, y, w, h = (box[n] for n in RECT)
            pixels[y : y + h, x : x + w] = crop
        out.append({"data": png.encode(pixels), "restored": len(crops)})
    return pa.array(out, pa.struct([("data", pa.binary()), ("restored", pa.int32()), ("error", pa.string())]))


def reveal_images(responses: DataFrame, sessions: DataFrame, secret: str, now: Column, data: str = "data") -> DataFrame:
    """(…responses, status, restored, n_restored): every hidden box put back.

    ``sessions`` has session_id, encrypted_mappings, expires_at and is_purged. The
    status is OK, NOT_FOUND, EXPIRED, PURGED, MISMATCH for an image that is larger or
    smaller than the one that was shielded, or UNREADABLE; only OK gives an image.
    """
    met = responses.join(sessions.select("session_id", "encrypted_mappings", "expires_at", "is_purged"), "session_id", "left")
    found = F.when(F.col("encrypted_mappings").isNull(), "NOT_FOUND").when(F.col("is_purged"), "PURGED").when(now > F.col("expires_at"), "EXPIRED")
    stored = F.col("encrypted_mappings") if dict(sessions.dtypes)["encrypted_mappings"] == "binary" else F.unbase64("encrypted_mappings")
    plain = F.when(found.isNull(), F.aes_decrypt(stored, F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")))
    # responses meet their sessions once, whatever their status
    restored = F.arrow_udf(_restore, _RESTORED).asNondeterministic()
    out = met.withColumn("_found", found).withColumn("_r", restored(F.when(found.isNull(), F.col(data)), plain))
    out = out.withColumns({"status": F.coalesce("_found", "_r.error", F.lit("OK")), "n_restored": F.coalesce("_r.restored", F.lit(0)), "restored": F.col("_r.data")})
    return out.drop("_found", "_r", "encrypted_mappings", "expires_at", "is_purged")
