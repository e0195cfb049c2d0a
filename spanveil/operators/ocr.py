"""Words that OCR found on images, as tables: their text, entities' boxes, phrases and coverage.

A word is a row (image, line_no, word_no, text, x, y, width, height). Joins carry the
image as their equal key, so a range or overlap is only tested within one image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.operators.geometry import clamped, intersection, rects_overlap

RECT = ("x", "y", "width", "height")


def scale_factor(width: Column, height: Column) -> Column:
    """How to resize an image before OCR: large ones to 2000 pixels, small ones up to three times."""
    long, short = F.greatest(width, height), F.least(width, height)
    up = lambda to, side: F.least(F.lit(3.0), F.lit(float(to)) / side)
    return F.when(short <= 0, 1.0).when(long > 2000, 2000.0 / long).when(short < 400, up(400, short)).when(long < 600, up(600, long)).otherwise(1.0)


def rescaled(rect: dict[str, Column], scale: Column) -> dict[str, Column]:
    """A rectangle of a resized image on the image itself."""
    return {n: rect[n] / scale for n in RECT}


def image_size(data: Column) -> Column:
    """struct<width, height> from the header of a PNG, GIF or BMP file; null for others."""
    unsigned = lambda *at: F.conv(F.concat(*[F.hex(F.substring(data, i, 1)) for i in at]), 16, 10).cast("long")
    # a picture stored from the top down has a height below zero
    number = lambda *at: F.when(unsigned(*at) >= 1 << 31, (1 << 32) - unsigned(*at)).otherwise(unsigned(*at)).cast("int")
    size = lambda w, h: F.struct(number(*w).alias("width"), number(*h).alias("height"))
    starts = lambda magic: F.hex(F.substring(data, 1, len(magic) // 2)) == magic
    return (
        F.when(starts("89504E470D0A1A0A"), size((17, 18, 19, 20), (21, 22, 23, 24)))
        .when(starts("47494638"), size((8, 7), (10, 9)))
        .when(starts("424D"), size((22, 21, 20, 19), (26, 25, 24, 23)))
    )


def tsv_words(pages: DataFrame, image: str = "image_id", tsv: str = "tsv") -> DataFrame:
    """Words of OCR output in TSV with twelve columns; rows of other levels, without confidence or text are left out.

    ``line_no`` counts the lines of an image in the order of page, block, paragraph and line.
    """
    cell = lambda i: F.element_at("c", i)
    rows = pages.select(image, F.explode(F.split(tsv, r"\r?\n")).alias("row")).select(image, F.split("row", "\t").alias("c")).where((F.size("c") == 12) & (cell(1) == "5"))
    number = lambda i: F.expr(f"try_cast(element_at(c, {i}) AS double)")
    place = F.struct(*[number(i).cast("int").alias(n) for i, n in ((2, "page"), (3, "block"), (4, "paragraph"), (5, "line"))])
    words = rows.select(image, place.alias("place"), number(6).cast("int").alias("word_no"), F.trim(cell(12)).alias("text"), *[number(7 + i).alias(n) for i, n in enumerate(RECT)], number(11).alias("confidence"))
    order = Window.partitionBy(image).orderBy("place")
    return words.where("text <> '' and confidence >= 0").withColumn("line_no", F.dense_rank().over(order)).drop("place")


def text_offsets(words: DataFrame, image: str = "image_id") -> DataFrame:
    """``words`` with start and end in the text of their image, where one blank or line end parts words."""
    before = Window.partitionBy(image).orderBy("line_no", "word_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return words.withColumn("start", start).withColumn("end", (F.col("start") + F.length("text")).cast("int"))


def image_text(words: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, text): words joined by blanks, lines by line ends."""
    joined = lambda key, value, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda w: w[value]), by)
    lines = words.groupBy(image, "line_no").agg(joined("word_no", "text", " ").alias("line"))
    return lines.groupBy(image).agg(joined("line_no", "line", "\n").alias("text"))


def _bounds() -> list[Column]:
    left, top = F.min("x"), F.min("y")
    return [left.alias("x"), top.alias("y"), (F.max(F.col("x") + F.col("width")) - left).alias("width"), (F.max(F.col("y") + F.col("height")) - top).alias("height")]


def entity_boxes(entities: DataFrame, words: DataFrame, image: str = "image_id", padding: float = 2.0, size: tuple[str, str] | None = None) -> DataFrame:
    """(image, entity_id, line_no, x, y, width, height): a box for each line that an entity (image, entity_id, start, end) touches.

    ``words`` have offsets. ``size``: columns of ``entities`` with the image's width and height, which bound the boxes.
    """
    keep = [F.first(c).alias(c) for c in size or ()]
    met = entities.select(image, "entity_id", F.col("start").alias("_from"), F.col("end").alias("_to"), *(size or ())).join(words, image).where("end > _from and start < _to")
    boxes = met.groupBy(image, "entity_id", "line_no").agg(*_bounds(), *keep)
    rect = {"x": F.col("x") - padding, "y": F.col("y") - padding, "width": F.col("width") + 2 * padding, "height": F.col("height") + 2 * padding}
    if size:
        rect = clamped(rect, F.col(size[0]), F.col(size[1]))
    return boxes.select(image, "entity_id", "line_no", *[rect[n].alias(n) for n in RECT])


def text_under(boxes: DataFrame, words: DataFrame, image: str = "image_id", least: float = 0.5) -> DataFrame:
    """(image, box_id, phrase): the words that lie in a box (image, box_id, x, y, width, height) for the most part, in reading order."""
    box = boxes.select(image, "box_id", *[F.col(n).alias(f"_{n}") for n in RECT])
    a, b = {n: F.col(n) for n in RECT}, {n: F.col(f"_{n}") for n in RECT}
    met = words.join(box, image).where(intersection(a, b) >= least * F.col("width") * F.col("height")).where("width > 0 and height > 0")
    read = F.array_sort(F.collect_list(F.struct("line_no", "word_no", "text")))
    return met.groupBy(image, "box_id").agg(F.array_join(F.transform(read, lambda w: w["text"]), " ").alias("phrase"))


def clean(word: Column) -> Column:
    """A word in lower case without punctuation at its edges."""
    return F.lower(F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", ""))


def phrase_boxes(phrases: DataFrame, words: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, phrase_id, line_no, word_no, x, y, width, height): every place of a phrase (image, phrase_id, phrase) within a line.

    Lines meet the phrases of their image, each line once and never a word with its line;
    places are found within it.
    """
    tokens = F.filter(F.transform(F.split(F.trim("phrase"), r"\s+"), clean), lambda w: w != "")
    wanted = phrases.select(image, "phrase_id", tokens.alias("_wanted")).where(F.size("_wanted") > 0)
    word = F.struct("word_no", clean(F.col("text")).alias("token"), *RECT)
    lines = words.groupBy(image, "line_no").agg(F.array_sort(F.collect_list(word)).alias("_line"))
    lines = lines.withColumn("_tokens", F.transform("_line", lambda w: w["token"]))
    met = lines.join(wanted, image).where(F.array_contains("_tokens", F.element_at("_wanted", 1)))
    begins = F.filter(F.sequence(F.lit(1), F.size("_line")), lambda i: F.slice("_tokens", i, F.size("_wanted")) == F.col("_wanted"))
    met = met.select(image, "phrase_id", "line_no", "_line", "_wanted", F.explode(begins).alias("_at")).withColumn("_found", F.slice("_line", F.col("_at"), F.size("_wanted")))
    low = lambda n: F.array_min(F.transform("_found", lambda w: w[n]))
    high = lambda n, size: F.array_max(F.transform("_found", lambda w: w[n] + w[size]))
    return met.select(image, "phrase_id", "line_no", F.element_at("_found", 1)["word_no"].alias("word_no"), low("x").alias("x"), low("y").alias("y"), (high("x", "width") - low("x")).alias("width"), (high("y", "height") - low("y")).alias("height"))


def word_boxes(phrases: DataFrame, words: DataFrame, image: str = "image_id", least: int = 4) -> DataFrame:
    """(image, phrase_id, line_no, word_no, x, y, width, height): every word that is, or has in it, a phrase of one word (image, phrase_id, phrase).

    Phrases shorter than ``least`` letters must be the word, punctuation aside. A word
    that several phrases find is listed once, for the longest phrase.
    """
    token = clean(F.col("phrase"))
    wanted = phrases.where(~F.trim("phrase").rlike(r"\s")).select(image, "phrase_id", token.alias("_token")).where("_token <> ''")
    bare = clean(F.col("text"))
    met = words.join(wanted, image).where((bare == F.col("_token")) | (F.lower("text") == F.col("_token")) | ((F.length("_token") >= least) & bare.contains(F.col("_token"))))
    best = Window.partitionBy(image, "line_no", "word_no").orderBy(F.length("_token").desc(), "phrase_id")
    return met.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(image, "phrase_id", "line_no", "word_no", *RECT)


def uncovered(found: DataFrame, boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """Rows of ``found`` that no box of their image overlaps."""
    box = boxes.select(F.col(image).alias("_image"), *[F.col(n).alias(f"_{n}") for n in RECT])
    a, b = {n: F.col(n) for n in RECT}, {n: F.col(f"_{n}") for n in RECT}
    return found.join(box, (F.col(image) == F.col("_image")) & rects_overlap(a, b), "left_anti")
