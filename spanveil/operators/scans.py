"""What text recognition and vector graphics give, as tables of words, and boxes for values that words don't place.

Words are rows (image, line_no, word_no, text, x, y, width, height, confidence), as in ``ocr``.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.spans import let, staged
from spanveil.operators.ocr import RECT, image_size

_BOX = "bbox:struct<x0:double,y0:double,x1:double,y1:double>"
_SYMBOL = f"struct<text:string,{_BOX}>"
_WORD = f"struct<text:string,{_BOX},confidence:double,symbols:array<{_SYMBOL}>>"
_LINE = f"struct<text:string,{_BOX},confidence:double,words:array<{_WORD}>>"
#: A page of recognised text in JSON: lines, or blocks with paragraphs or lines, or words alone, or TSV.
PAGE = f"struct<lines:array<{_LINE}>,blocks:array<struct<paragraphs:array<struct<lines:array<{_LINE}>>>,lines:array<{_LINE}>>>,words:array<{_WORD}>,tsv:string>"
# What holds where the output has no confidence, and gaps and least widths of estimated words.
CONFIDENCE, SVG_CONFIDENCE, GAP, SVG_GAP, LEAST_WIDTH = 90.0, 99.0, 4, 6, 10
# Types whose values run over several lines, and what placeholders of such have in them.
WRAPPING = ("API_KEY", "PASSWORD", "CONNECTION_STRING", "JWT_TOKEN", "SOURCE_CODE_SECRET", "COMPANY_SECRET", "PRIVATE_KEY", "TOKEN")
WRAPPING_NAMES = ("PASS", "KEY", "SECRET", "TOKEN", "CONN")


def whole(value: Column) -> Column:
    """The nearest whole number; of two the greater."""
    return F.floor(value + 0.5).cast("double")


def _edges(low: Column, high: Column, size: Column, scale: Column) -> Column:
    """struct<at, size> of an interval on the image itself, a pixel long at least."""
    begin = F.greatest(F.lit(0.0), F.least(size - 1, whole(low * scale)))
    return let(begin, lambda b: F.struct(b.alias("at"), (F.greatest(b + 1, F.least(size, whole(high * scale))) - b).alias("size")))


def _rect(box: Column, default: Column, more: tuple[float, float], scaling: tuple[Column, Column, Column]) -> Column:
    """A box on the image itself; sides that it lacks follow from ``default``, the box around it, and ``more``."""
    width, height, scale = scaling
    x0, y0 = F.coalesce(box["x0"], default["x0"]), F.coalesce(box["y0"], default["y0"])
    x, y = _edges(x0, F.coalesce(box["x1"], x0 + more[0]), width, scale), _edges(y0, F.coalesce(box["y1"], y0 + more[1]), height, scale)
    return let(F.struct(x.alias("x"), y.alias("y")), lambda r: F.struct(r["x"]["at"].alias("x"), r["y"]["at"].alias("y"), r["x"]["size"].alias("width"), r["y"]["size"].alias("height")))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _sums(values: Column) -> Column:
    """Sums of an array's values up to each of them.

    Each takes in what stands 1, 2, 4, ... places before it: n values need log n rounds
    over the array, and not for each of them a way through all before it.
    """
    places = F.array(*[F.lit(1 << k) for k in range(31)])  # an array has less than 2^31 values
    further = lambda sums, k: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - k), F.lit(0.0)))
    return let(values, lambda vs: F.aggregate(F.filter(places, lambda k: k < F.size(vs)), vs, further))


def _estimated(text: Column, rect: Column, unit: Column, gap: int, confidence: Column) -> Column:
    """Words of a line of which only the line's place is known, side by side, each as wide as its letters."""
    tokens = F.filter(F.split(_trimmed(text), r"\s+"), lambda t: t != "")
    widths = lambda ts, unit: F.transform(ts, lambda t: F.greatest(F.lit(float(LEAST_WIDTH)), whole(F.length(t) * unit)))

    def words(line: Column, ts: Column, ws: Column, ends: Column) -> Column:
        left = lambda i: line["x"] + float(gap) * i + F.coalesce(F.get(ends, i - 1), F.lit(0.0))
        placed = lambda i: F.struct(left(i).alias("x"), line["y"].alias("y"), F.get(ws, i).alias("width"), line["height"].alias("height"))
        return F.transform(ts, lambda t, i: F.struct(t.alias("text"), placed(i).alias("rect"), line["confidence"].alias("confidence"), F.array().cast(f"array<{_PLACED}>").alias("symbols")))

    # what holds for the whole line is computed once, not for each word
    of_line = F.struct(*[rect[n].alias(n) for n in ("x", "y", "height")], unit.alias("unit"), confidence.alias("confidence"))
    sized = lambda line, ts: let(widths(ts, line["unit"]), lambda ws: let(_sums(ws), lambda ends: words(line, ts, ws, ends)))
    return let(of_line, lambda line: let(tokens, lambda ts: sized(line, ts)))


_PLACED = "struct<text:string,rect:struct<x:double,y:double,width:double,height:double>>"
_PLACED_WORD = f"struct<text:string,rect:struct<x:double,y:double,width:double,height:double>,confidence:double,symbols:array<{_PLACED}>>"
_ROW = f"struct<line_no:int,word_no:int,{_PLACED_WORD.removeprefix('struct<')}"


def json_words(pages: DataFrame, image: str = "image_id", page: str = "page", width: str = "width", height: str = "height", scale: str | None = None) -> DataFrame:
    """Words of recognised pages in JSON, each with its symbols (text, rect), on the image itself.

    ``scale``: column by which coordinates of a resized image become those of the image.
    Boxes are cut at the image's edges. A line without words is cut into words of
    estimated width; a page without lines has a line for each word; a page of neither
    is read from its TSV. Blank lines, words and symbols are left out, and so are pages
    that aren't JSON.
    """
    scaling = (F.col(width).cast("double"), F.col(height).cast("double"), F.col(scale).cast("double") if scale else F.lit(1.0))
    read = pages.select(image, width, height, *([scale] if scale else []), F.from_json(F.col(page), PAGE).alias("_p"))
    of_block = lambda b: F.when(b["paragraphs"].isNotNull(), F.flatten(F.transform(b["paragraphs"], lambda p: F.coalesce(p["lines"], F.array().cast(f"array<{_LINE}>"))))).otherwise(F.coalesce(b["lines"], F.array().cast(f"array<{_LINE}>")))
    lines = F.when(F.size("_p.lines") > 0, F.col("_p.lines")).otherwise(F.flatten(F.transform("_p.blocks", of_block)))
    lines = F.filter(F.coalesce(lines, F.array().cast(f"array<{_LINE}>")), lambda x: F.coalesce(_trimmed(x["text"]) != "", F.lit(False)))
    filled = lambda xs: F.filter(F.coalesce(xs, F.array()), lambda x: F.coalesce(_trimmed(x["text"]) != "", F.lit(False)))
    origin = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"))

    def corner(box: Column, outer: Column) -> Column:
        return F.struct(F.coalesce(box["x0"], outer["x0"]).alias("x0"), F.coalesce(box["y0"], outer["y0"]).alias("y0"))

    def word(w: Column, outer: Column) -> Column:
        inner = corner(w["bbox"], outer)
        symbols = F.transform(filled(w["symbols"]), lambda s: F.struct(s["text"].alias("text"), _rect(s["bbox"], inner, (5, 10), scaling).alias("rect")))
        sure = F.when(F.coalesce(w["confidence"], F.lit(0.0)) != 0, w["confidence"]).otherwise(CONFIDENCE)
        return F.struct(_trimmed(w["text"]).alias("text"), _rect(w["bbox"], outer, (10, 10), scaling).alias("rect"), sure.alias("confidence"), F.coalesce(symbols, F.array().cast(f"array<{_PLACED}>")).alias("symbols")).cast(_PLACED_WORD)

    def line(x: Column) -> Column:
        outer, rect = corner(x["bbox"], origin), _rect(x["bbox"], origin, (100, 24), scaling)
        sure = F.when(F.coalesce(x["confidence"], F.lit(0.0)) != 0, x["confidence"]).otherwise(CONFIDENCE)
        unit = rect["width"] / F.greatest(F.lit(1), F.length(_trimmed(x["text"])))
        guessed = _estimated(x["text"], rect, unit, GAP, sure).cast(f"array<{_PLACED_WORD}>")
        return F.when(F.size(x["words"]) > 0, F.transform(filled(x["words"]), lambda w: word(w, outer))).otherwise(guessed)

    placed = lambda w, at, k: F.struct((at + 1).alias("line_no"), (k + 1).alias("word_no"), w["text"].alias("text"), w["rect"].alias("rect"), w["confidence"].alias("confidence"), w["symbols"].alias("symbols")).cast(_ROW)
    of_lines = lambda xs: F.flatten(F.transform(xs, lambda x, at: F.transform(line(x), lambda w, k: placed(w, at, k))))
    alone = lambda ws: F.transform(ws, lambda w, at: placed(word(w, origin), at, F.lit(0)))
    # one way through each page: a page of another kind isn't read a second time
    read = staged(read, _lines=lines, _words=filled(F.col("_p.words")), _tsv=F.col("_p.tsv")).drop("_p")
    rows = F.when(F.size("_lines") > 0, of_lines(F.col("_lines"))).when(F.size("_words") > 0, alone(F.col("_words"))).otherwise(_tsv_rows(F.col("_tsv")))
    rows = read.select(image, F.explode(rows).alias("w"))
    return rows.select(image, "w.line_no", "w.word_no", "w.text", *[F.col(f"w.rect.{n}").alias(n) for n in RECT], "w.confidence", "w.symbols")


def _tsv_rows(tsv: Column) -> Column:
    """Words of a page in TSV as ``tsv_words`` finds them, in an array."""
    cell = lambda c, i: F.get(c, i - 1)
    number = lambda c, i: cell(c, i).try_cast("double")
    cells = F.filter(F.transform(F.split(tsv, r"\r?\n"), lambda r: F.split(r, "\t")), lambda c: (F.size(c) == 12) & (cell(c, 1) == "5"))
    place = lambda c: F.struct(*[number(c, i).cast("int").alias(n) for i, n in ((2, "page"), (3, "block"), (4, "paragraph"), (5, "line"))])
    rect = lambda c: F.struct(*[number(c, 7 + i).alias(n) for i, n in enumerate(RECT)])
    found = F.transform(cells, lambda c: F.struct(place(c).alias("place"), number(c, 6).cast("int").alias("word_no"), F.trim(cell(c, 12)).alias("text"), rect(c).alias("rect"), number(c, 11).alias("confidence")))
    found = F.filter(found, lambda w: (w["text"] != "") & (w["confidence"] >= 0))
    row = lambda w, places: F.struct(F.array_position(places, w["place"]).cast("int").alias("line_no"), w["word_no"].alias("word_no"), w["text"].alias("text"), w["rect"].alias("rect"), w["confidence"].alias("confidence"), F.array().cast(f"array<{_PLACED}>").alias("symbols")).cast(_ROW)
    return let(found, lambda ws: let(F.array_sort(F.array_distinct(F.transform(ws, lambda w: w["place"]))), lambda places: F.transform(ws, lambda w: row(w, places))))


def decoded(markup: Column) -> Column:
    """Text of markup: tags left out, the five named characters put in (ampersands last, so that none is read twice)."""
    out = F.regexp_replace(markup, r"<[^>]+>", "")
    for name, char in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def svg_lines(pages: DataFrame, image: str = "image_id", svg: str = "svg") -> DataFrame:
    """Text elements of vector graphics that aren't blank, each with all its ``words`` (text, rect, confidence, symbols).

    An element is a line; its words stand side by side from its place on, with widths
    estimated from the size of its font. An element without place is at 50, 50; a font
    without size has 14 pixels.
    """
    elements = F.regexp_extract_all(F.col(svg), F.lit(r"(?is)<text\s+[^>]*?>.*?</text>"), F.lit(0))
    rows = pages.select(image, F.posexplode(elements).alias("_l", "_e"))
    head, body = F.regexp_extract("_e", r"(?is)^<text\s+([^>]*?)>", 1), F.regexp_extract("_e", r"(?is)^<text\s+[^>]*?>(.*)</text>$", 1)
    rows = staged(rows, _a=head, _t=_trimmed(decoded(body))).where("_t <> ''")

    def number(name: str, default: float) -> Column:
        found = F.regexp_extract("_a", rf"""(?i){name}=["']?(\d+(?:\.\d+)?)["']?""", 1)
        return let(found, lambda n: F.when(n == "", default).otherwise(n.cast("double")))

    rows = staged(rows, _x=number(r"\bx", 50.0), _y=number(r"\by", 50.0), _s=number("font-size", 14.0))
    rect = F.struct(whole(F.col("_x")).alias("x"), F.greatest(F.lit(0.0), whole(F.col("_y") - F.col("_s"))).alias("y"), F.greatest(F.lit(14.0), whole(F.col("_s") * 1.3)).alias("height"))
    words = _estimated(F.col("_t"), rect, F.col("_s") * 0.6, SVG_GAP, F.lit(SVG_CONFIDENCE))
    return rows.select(image, (F.col("_l") + 1).alias("line_no"), words.alias("words"))


def svg_words(pages: DataFrame, image: str = "image_id", svg: str = "svg") -> DataFrame:
    """Words of the text elements of vector graphics (``svg_lines``), a row each."""
    out = svg_lines(pages, image, svg).select(image, "line_no", F.posexplode("words").alias("_w", "w"))
    return out.select(image, "line_no", (F.col("_w") + 1).alias("word_no"), "w.text", *[F.col(f"w.rect.{n}").alias(n) for n in RECT], "w.confidence")


def _segments(data: bytes) -> tuple[int, int] | None:
    """Width and height from the frame header of a JPEG file, past the segments before it."""
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        # fill bytes and marks without a body
        at += 1 if kind == 0xFF else 2 if kind in (0x00, 0x01) or 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4])
    return None


def _webp(data: bytes) -> tuple[int, int] | None:
    """Width and height from the first chunk of a WebP file, of any of its three kinds."""
    little = lambda at, n: int.from_bytes(data[at : at + n], "little")
    if len(data) < 30 or data[8:12] != b"WEBP":
        return None
    if data[12:16] == b"VP8 ":
        return little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    if data[12:16] == b"VP8L":
        bits = little(21, 4)
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return (1 + little(24, 3), 1 + little(27, 3)) if data[12:16] == b"VP8X" else None


def file_size(data: Column) -> Column:
    """struct<width, height> of PNG, GIF, BMP, JPEG and WebP files; null for others and for damaged ones.

    The first three are read by built-in functions from their headers; only files of
    the other two go through Python.
    """

    def read(files: pa.Array) -> pa.Array:
        out = []
        for body in files.to_pylist():
            size = body and (_segments if body[:2] == b"\xff\xd8" else _webp)(body)
            out.append({"width": size[0], "height": size[1]} if size and size[0] and size[1] else None)
        return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32())]))

    start = F.hex(F.substring(data, 1, 4))
    walked = F.when(start.startswith("FFD8") | (start == "52494646"), data)
    plain = image_size(data)
    ok = (plain["width"] > 0) & (plain["height"] > 0)
    return F.coalesce(F.when(ok, plain), F.arrow_udf(read, "struct<width:int,height:int>")(walked))


def _bare(text: str) -> str:
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum())


def _share(words: list[dict], text: str, line: dict) -> tuple[float, float, float, float, float] | None:
    """x, y, right, bottom and letter height of a value in a line: in one word, in several, or by its share of the line."""
    wanted, bare = text.lower(), _bare(text)
    height = (words[0]["height"] if words else 0) or line["height"] or 20
    for w in words:
        at = w["text"].lower().find(wanted)
        if at < 0:
            continue
        own = [s["rect"] for s in w["symbols"] or []][at : at + len(text)]
        if len(own) == len(text):
            return min(r["x"] for r in own), min(r["y"] for r in own), max(r["x"] + r["width"] for r in own), max(r["y"] + r["height"] for r in own), height
        unit = w["width"] / max(1, len(w["text"]))
        x = math.floor(w["x"] + at * unit + 0.5)
        return x, w["y"], x + math.floor(len(text) * unit + 0.5), w["y"] + w["height"], height
    holds = lambda group: wanted in (joined := " ".join(w["text"].lower() for w in group)) or (bare and bare in _bare(joined))
    end = next((j for j in range(1, len(words) + 1) if holds(words[:j])), 0)
    if not end:
        return None
    # the fewest words up to there
    group = words[next(i for i in range(end - 1, -1, -1) if holds(words[i:end])) : end]
    return min(w["x"] for w in group), min(w["y"] for w in group), max(w["x"] + w["width"] for w in group), max(w["y"] + w["height"] for w in group), height


def _part(text: str, line: dict, words: list[dict]) -> tuple[float, float, float, float, float]:
    """The share of a line that a value takes by its place among the letters."""
    whole_line, bare, own = line["text"], _bare(line["text"]), _bare(text)
    at = whole_line.lower().find(text.lower())
    size = len(text)
    if at < 0:
        found = bare.find(own)
        found = bare.find(own[:10]) if found < 0 else found
        at = int(max(0, found) / max(1, len(bare)) * len(whole_line))
        size = max(4, int(len(own) / max(1, len(bare)) * len(whole_line)))
    unit = line["width"] / max(1, len(whole_line))
    x = math.floor(line["x"] + at * unit + 0.5)
    height = (words[0]["height"] if words else 0) or line["height"] or 20
    return x, line["y"], x + math.floor(size * unit + 0.5), line["y"] + line["height"], height


def _padded(place: tuple[float, float, float, float, float], width: float, height: float) -> dict:
    x, y, right, bottom, letter = place
    side = lambda share, least: max(least, math.floor(letter * share + 0.5))
    pad_x, pad_y = side(0.25, 4), side(0.15, 2)
    return {"x": max(0, x - pad_x), "y": max(0, y - pad_y), "width": min(width - x, max(side(0.9, 12), right - x + 2 * pad_x)), "height": min(height - y, max(side(0.8, 8), bottom - y + 2 * pad_y))}


def _spread_out(text: str, number: int, lines: int, width: float, height: float) -> dict:
    """A box somewhere down the image for a value that nothing places."""
    slots = max(4, lines or 8, number)
    line = max(12, min(28, height // max(2, slots + 1)))
    step = max(16, height - line - 8) / max(1, slots - 1)
    y = min(height - line - 4, max(4, math.floor(4 + (number - 1) * step + 0.5)))
    letter = max(8, min(14, math.floor(width * 0.012)))
    wide = min(math.floor(width * 0.8), max(120, len(text) * letter))
    return {"x": max(10, min(width - wide - 10, math.floor(width * 0.12))), "y": y, "width": wide, "height": line}


_FOUND = "struct<how:string,x:double,y:double,width:double,height:double>"


def _find_boxes(text: pa.Array, number: pa.Array, lines: pa.Array, width: pa.Array, height: pa.Array, line: pa.Array, word: pa.Array) -> pa.Array:
    out = []
    for t, k, n, w, h, chosen, alone in zip(*(x.to_pylist() for x in (text, number, lines, width, height, line, word)), strict=True):
        if chosen:
            words = chosen["words"] or []
            place, how = _share(words, t, chosen), "words"
            if place is None:
                place, how = _part(t, chosen, words), "line"
            box = _padded(place, w, h)
        elif alone:
            box, how = _padded((alone["x"], alone["y"], alone["x"] + alone["width"], alone["y"] + alone["height"], alone["height"] or 20), w, h), "word"
        else:
            box, how = _spread_out(t, k, n or 0, w, h), "none"
        out.append({"how": how, **{c: float(box[c]) for c in RECT}})
    return pa.array(out, pa.struct([("how", pa.string()), *[(c, pa.float64()) for c in RECT]]))


def fallback_boxes(entities: DataFrame, words: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, entity_id, how, x, y, width, height): one box for each entity (image, entity_id, text, width, height) that offsets don't place.

    Lines of the image that have the value rank by how they have it: as it is, without
    punctuation, or its beginning; then by their place. The n-th entity of one value
    takes the n-th such line. Without a line, a word that holds the value or is held by it; without one, a
    place down the image. ``words`` may have symbols.
    """
    symbols = F.col("symbols") if "symbols" in words.columns else F.array().cast(f"array<{_PLACED}>")
    word = F.struct("word_no", "text", *RECT, symbols.alias("symbols"))
    grouped = words.groupBy(image, "line_no").agg(F.array_sort(F.collect_list(word)).alias("_w"), *[F.min(c).alias(c) for c in ("x", "y")], F.max(F.col("x") + F.col("width")).alias("_r"), F.max(F.col("y") + F.col("height")).alias("_b"))
    lines = grouped.select(image, "line_no", F.struct(F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"), "x", "y", (F.col("_r") - F.col("x")).alias("width"), (F.col("_b") - F.col("y")).alias("height"), F.col("_w").alias("words")).alias("line"))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    order = Window.partitionBy(image).orderBy("entity_id")
    same = Window.partitionBy(image, F.lower(F.trim("text"))).orderBy("entity_id")
    asked = entities.where("trim(text) <> ''").select(image, "entity_id", F.trim("text").alias("text"), F.col("width").alias("_width"), F.col("height").alias("_height"), F.row_number().over(order).alias("_no"), F.row_number().over(same).alias("_nth"))
    met = asked.select(image, "entity_id", "text", "_nth").join(lines, image)
    own, line_bare = bare(F.col("text")), bare(F.col("line.text"))
    rank = (
        F.when(F.lower("line.text").contains(F.lower("text")), 1000)
        .when((F.length(own) >= 4) & line_bare.contains(own), 800)
        .when((F.length(own) >= 6) & line_bare.contains(F.substring(own, 1, 10)), 500)
    )
    ranked = met.withColumn("_rank", rank).where("_rank is not null")
    by_line = Window.partitionBy(image, "entity_id").orderBy(F.desc("_rank"), "line_no")
    ranked = ranked.withColumns({"_k": F.row_number().over(by_line), "_all": F.count(F.lit(1)).over(Window.partitionBy(image, "entity_id"))})
    chosen = ranked.where(F.col("_k") == F.least("_nth", "_all")).select(image, "entity_id", "line")
    loose = asked.join(chosen.select(image, "entity_id"), [image, "entity_id"], "left_anti").select(image, "entity_id", "text", "_nth")
    held = loose.join(words.select(image, "line_no", "word_no", F.col("text").alias("_t"), *RECT), image)
    held = held.where(F.lower("_t").contains(F.lower("text")) | F.lower("text").contains(F.lower("_t")))
    by_word = Window.partitionBy(image, "entity_id")
    held = held.withColumns({"_k": F.row_number().over(by_word.orderBy("line_no", "word_no")), "_all": F.count(F.lit(1)).over(by_word)})
    held = held.where(F.col("_k") == F.least("_nth", "_all")).select(image, "entity_id", F.struct(*RECT).alias("word"))
    counts = lines.groupBy(image).agg(F.count(F.lit(1)).alias("_lines"))
    every = asked.join(chosen, [image, "entity_id"], "left").join(held, [image, "entity_id"], "left").join(counts, image, "left")
    box = F.arrow_udf(_find_boxes, _FOUND).asNondeterministic()(F.col("text"), F.col("_no"), F.col("_lines"), F.col("_width").cast("double"), F.col("_height").cast("double"), F.col("line"), F.col("word"))
    return every.select(image, "entity_id", box.alias("_box")).select(image, "entity_id", "_box.*")


def continued_boxes(boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """``boxes`` (image, box_no, entity_type, placeholder, evidence, x, y, width, height) with continues and chain_no.

    A box continues one before it with the same placeholder when it lies on the next
    line below, roughly under it, and their value is said to wrap or is of a type that
    does. Boxes of one chain, which have one label, share its number within the
    placeholder's boxes.
    """
    wraps = lambda e: F.coalesce(F.lower(e).rlike("wrapped|continuation"), F.lit(False))
    long = lambda kind: F.coalesce(F.upper(kind).rlike("|".join(WRAPPING)), F.lit(False))
    cols = ["box_no", "entity_type", "evidence", *RECT]
    before = boxes.select(image, "placeholder", *[F.col(c).alias(f"_{c}") for c in cols])
    both = boxes.select(image, "placeholder", *cols).join(before, [image, "placeholder"]).where("_box_no < box_no")
    gap, line = F.col("y") - (F.col("_y") + F.col("_height")), F.greatest(F.lit(14.0), (F.col("height") + F.col("_height")) / 2)
    shared = F.least(F.col("_x") + F.col("_width"), F.col("x") + F.col("width")) - F.greatest("_x", "x")
    below = (gap >= -8) & (gap <= line * 1.35) & ((shared > 10) | (F.abs(F.col("x") - F.col("_x")) < 60))
    kind = long(F.col("entity_type")) | long(F.col("_entity_type")) | F.col("placeholder").rlike("|".join(WRAPPING_NAMES))
    found = both.where(below & (wraps(F.col("evidence")) | wraps(F.col("_evidence")) | kind)).select(image, "placeholder", "box_no").distinct()
    out = boxes.join(found.withColumn("_c", F.lit(True)), [image, "placeholder", "box_no"], "left").withColumn("continues", F.coalesce("_c", F.lit(False))).drop("_c")
    chain = F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(Window.partitionBy(image, "placeholder").orderBy("box_no"))
    return out.select(*boxes.columns, "continues", chain.alias("chain_no"))
