"""Recognised pages in JSON, vector graphics, sizes of files, boxes without offsets, continued boxes, overrides by line."""

import json
import math
import struct

from pyspark.sql import functions as F

from spanveil.operators.resolve import by_lines
from spanveil.operators.scans import continued_boxes, decoded, fallback_boxes, file_size, json_words, svg_words


def box(x0, y0, x1, y1):
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1}


PAGES = {
    1: {"lines": [{"text": "Hello wor ld", "bbox": box(10.4, 20, 210, 44), "confidence": 0, "words": [
        {"text": " Hello ", "bbox": box(10.4, 20, 90.2, 44), "confidence": 71.5, "symbols": [{"text": "H", "bbox": box(10.4, 20, 25, 44)}, {"text": "", "bbox": box(1, 1, 2, 2)}, {"text": "e"}]},
        {"text": "wor", "bbox": None}, {"text": "  "}, {"text": None}, {"text": "ld", "bbox": box(700, 20, 9000, 44)}]}, {"text": " "}, {"text": "no words here", "bbox": box(0, 100, 130, 120), "confidence": 80}]},
    2: {"lines": [], "blocks": [{"paragraphs": [{"lines": [{"text": "a", "words": [{"text": "a"}]}]}, {}]}, {"lines": [{"text": "b b", "bbox": box(5, 5, 6, 6), "words": []}]}, {}]},
    3: {"words": [{"text": "alone", "bbox": box(1, 2, 30, 12)}, {"text": ""}, {"text": "too"}]},
    4: {"tsv": "\t".join(["5", "1", "1", "1", "1", "1", "3", "4", "50", "6", "88", "cell"])},
    5: {},
}


def expected(page, width, height, scale):
    half = lambda v: math.floor(v + 0.5)

    def edges(low, high, size):
        a = max(0, min(size - 1, half(low * scale)))
        return a, max(a + 1, min(size, half(high * scale))) - a

    def rect(b, outer, more):
        x0, y0 = (b or {}).get("x0", outer[0]), (b or {}).get("y0", outer[1])
        (x, w), (y, h) = edges(x0, (b or {}).get("x1", x0 + more[0]), width), edges(y0, (b or {}).get("y1", y0 + more[1]), height)
        return (x, y, w, h), (x0, y0)

    lines = page.get("lines") or [x for b in page.get("blocks", []) for x in ([y for p in b["paragraphs"] for y in p.get("lines", [])] if "paragraphs" in b else b.get("lines", []))]
    lines = [x for x in lines if (x.get("text") or "").strip()]
    out = []
    for n, x in enumerate(lines, 1):
        r, corner = rect(x.get("bbox"), (0, 0), (100, 24))
        if x.get("words"):
            words = [w for w in x["words"] if (w.get("text") or "").strip()]
            out += [(n, k, w["text"].strip(), rect(w.get("bbox"), corner, (10, 10))[0], w.get("confidence") or 90) for k, w in enumerate(words, 1)]
        else:
            at, text = r[0], x["text"].strip()
            for k, t in enumerate(text.split(), 1):
                wide = max(10, half(len(t) * (r[2] / len(text))))
                out.append((n, k, t, (at, r[1], wide, r[3]), x.get("confidence") or 90))
                at += wide + 4
    if not lines:
        words = [w for w in page.get("words", []) if w["text"].strip()]
        out = [(n, 1, w["text"], rect(w.get("bbox"), (0, 0), (10, 10))[0], 90) for n, w in enumerate(words, 1)]
    return out


def test_pages_in_json(spark):
    rows = [(i, json.dumps(p), 800, 600, 1.25) for i, p in PAGES.items()] + [(6, "no json", 10, 10, 1.0), (7, None, 10, 10, 1.0)]
    table = spark.createDataFrame(rows, "image_id long, page string, width int, height int, scale double")
    found = {}
    for r in json_words(table, scale="scale").orderBy("image_id", "line_no", "word_no").collect():
        found.setdefault(r.image_id, []).append(r)
    mark = lambda rs: [(r.line_no, r.word_no, r.text, (r.x, r.y, r.width, r.height), r.confidence) for r in rs]
    for i in (1, 2, 3):
        assert mark(found[i]) == expected(PAGES[i], 800, 600, 1.25), i
    assert mark(found[4]) == [(1, 1, "cell", (3.0, 4.0, 50.0, 6.0), 88.0)] and set(found) == {1, 2, 3, 4}
    assert [(s.text, tuple(s.rect)) for s in found[1][0].symbols] == [("H", (13, 25, 18, 30)), ("e", (13, 25, 6, 13))]
    assert json_words(table.limit(0)).count() == 0


def test_vector_graphics(spark):
    svg = """<svg><text x="10.5" y='40' font-size="20">Key: <tspan>a&amp;lt;b</tspan> &lt;ok&gt;</text>
<TEXT class="t">one\n two</TEXT><text x="3"> </text><text>no blank after the name</text><rect/><text y=9 fill="x">“é”</text></svg>"""
    rows = svg_words(spark.createDataFrame([(1, svg), (2, None), (3, "<p>none</p>")], "image_id long, svg string")).orderBy("line_no", "word_no").collect()
    assert [(r.line_no, r.word_no, r.text, r.x, r.y, r.width, r.height) for r in rows] == [
        (1, 1, "Key:", 11, 20, 48, 26), (1, 2, "a&lt;b", 65, 20, 72, 26), (1, 3, "<ok>", 143, 20, 48, 26), (2, 1, "one", 50, 36, 25, 18), (2, 2, "two", 81, 36, 25, 18), (4, 1, "“é”", 50, 0, 25, 18),
    ]
    assert spark.range(1).select(decoded(F.lit("<b>&quot;x&apos;</b>&amp;&amp;quot;"))).first()[0] == "\"x'&&quot;"


def test_sizes_of_files(spark):
    frame = lambda kind, w, h: bytes([0xFF, kind]) + struct.pack(">HBHH", 17, 8, h, w) + bytes(10)
    skip = b"\xff\xe0\x00\x10" + b"\xff\xc0" * 7  # what looks like a frame lies inside a segment
    riff = lambda kind, body: b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + body + bytes(12)
    rows = [
        ("jpeg", b"\xff\xd8" + skip + frame(0xC0, 640, 480)), ("progressive", b"\xff\xd8\xff\xdb\x00\x04ab\xff\xff" + frame(0xC2, 5, 70)[1:]), ("tables only", b"\xff\xd8" + frame(0xC4, 5, 7) + bytes(8)),
        ("jpeg cut", b"\xff\xd8" + skip), ("lossy", riff(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300 | 0x4000, 200))), ("lossless", riff(b"VP8L", b"\x2f" + struct.pack("<I", 99 | 49 << 14))),
        ("extended", riff(b"VP8X", b"\0\0\0\0" + (1023).to_bytes(3, "little") + (511).to_bytes(3, "little"))), ("riff cut", b"RIFF\0\0\0\0WEBPVP8 "), ("wave", b"RIFF\0\0\0\0WAVE" + bytes(40)),
        ("bitmap", b"BM" + bytes(16) + struct.pack("<ii", 32, -16)), ("gif", b"GIF89a" + struct.pack("<HH", 7, 8) + bytes(9)), ("gif cut", b"GIF89a"), ("png", b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 12, 34)), ("none", None), ("empty", b""),
    ]
    found = {r.what: r.s and tuple(r.s) for r in spark.createDataFrame(rows, "what string, data binary").select("what", file_size(F.col("data")).alias("s")).collect()}
    assert found == {
        "jpeg": (640, 480), "progressive": (5, 70), "tables only": None, "jpeg cut": None, "lossy": (300, 200), "lossless": (100, 50), "extended": (1024, 512), "riff cut": None, "wave": None,
        "bitmap": (32, 16), "gif": (7, 8), "gif cut": None, "png": (12, 34), "none": None, "empty": None,
    }


WORDS = [
    (1, 1, 1, "Name:", 10.0, 10.0, 50.0, 20.0, None), (1, 1, 2, "Ada", 70.0, 10.0, 30.0, 20.0, None), (1, 1, 3, "Lovelace,", 110.0, 10.0, 90.0, 20.0, None),
    (1, 2, 1, "key=AB12-CD34!", 10.0, 50.0, 140.0, 20.0, [("k", (10.0, 50.0, 9.0, 20.0))]), (1, 3, 1, "Ada", 10.0, 90.0, 30.0, 20.0, None), (1, 3, 2, "Lovelace", 50.0, 90.0, 80.0, 20.0, None),
    (1, 4, 1, "tok", 10.0, 130.0, 30.0, 20.0, [("t", (10.0, 130.0, 8.0, 20.0)), ("o", (19.0, 131.0, 9.0, 20.0)), ("k", (29.0, 130.0, 11.0, 22.0))]),
]
WORD = "image_id long, line_no int, word_no int, text string, x double, y double, width double, height double, symbols array<struct<text:string,rect:struct<x:double,y:double,width:double,height:double>>>"


def test_boxes_that_offsets_do_not_place(spark):
    asked = [(1, 1, "Ada Lovelace"), (1, 2, "ada lovelace "), (1, 3, "Ada Lovelace"), (1, 4, "AB12CD34"), (1, 5, "AB12-CD34"), (1, 6, "AB12CD34EFGH"), (1, 7, "ok"), (1, 8, "Lovelace, x"), (1, 9, "Zebra"), (2, 1, "Zebra"), (1, 10, " ")]
    entities = spark.createDataFrame([(i, e, t, 400, 300) for i, e, t in asked], "image_id long, entity_id int, text string, width int, height int")
    found = {(r.image_id, r.entity_id): (r.how, r.x, r.y, r.width, r.height) for r in fallback_boxes(entities, spark.createDataFrame(WORDS, WORD)).collect()}
    assert len(found) == 10
    assert found[1, 1] == ("words", 65, 7, 140, 26) and found[1, 2] == ("words", 5, 87, 130, 26) and found[1, 3] == found[1, 2]
    assert found[1, 4] == ("words", 5, 47, 150, 26) and found[1, 5] == ("words", 45, 47, 100, 26)
    assert found[1, 6][0] == "none" and found[1, 7] == ("words", 14, 127, 31, 28)
    assert found[1, 8] == ("word", 105, 7, 100, 26) and found[1, 9][0] == "none" and found[2, 1][0] == "none"
    assert found[1, 9][2] > found[2, 1][2] == 4 and all(x >= 0 and x + w <= 400 and y + h <= 300 for _, x, y, w, h in found.values())
    bare = spark.createDataFrame(WORDS, WORD).drop("symbols")
    assert fallback_boxes(entities, bare).count() == 10 and fallback_boxes(entities.limit(0), bare).count() == 0


def test_continued_boxes(spark):
    key, name = "[[API_KEY_001]]", "[[PERSON_NAME_001]]"
    boxes = [
        (1, 1, "API_KEY", key, None, 10.0, 10.0, 200.0, 20.0), (1, 2, "API_KEY", key, None, 10.0, 32.0, 100.0, 20.0), (1, 3, "API_KEY", key, None, 10.0, 54.0, 50.0, 20.0), (1, 4, "API_KEY", key, None, 10.0, 200.0, 50.0, 20.0),
        (1, 5, "PERSON_NAME", name, None, 10.0, 10.0, 50.0, 20.0), (1, 6, "PERSON_NAME", name, None, 10.0, 32.0, 50.0, 20.0), (1, 7, "PERSON_NAME", name, "line-wrapped", 10.0, 54.0, 50.0, 20.0), (1, 8, "API_KEY", key, None, 300.0, 222.0, 50.0, 20.0),
        (2, 1, "API_KEY", key, None, 10.0, 32.0, 100.0, 20.0), (2, 2, "API_KEY", None, None, 10.0, 54.0, 100.0, 20.0),
    ]
    table = spark.createDataFrame(boxes, "image_id long, box_no int, entity_type string, placeholder string, evidence string, x double, y double, width double, height double")
    found = {(r.image_id, r.box_no): (r.continues, r.chain_no) for r in continued_boxes(table).collect()}
    assert found == {(1, 1): (False, 1), (1, 2): (True, 1), (1, 3): (True, 1), (1, 4): (False, 2), (1, 5): (False, 1), (1, 6): (False, 2), (1, 7): (True, 2), (1, 8): (False, 3), (2, 1): (False, 1), (2, 2): (False, 1)}


def test_overrides_by_line(spark):
    text = "one\r\n  two \r\n\r\nthree four\nfive"
    kind = "array<struct<start:int,end:int,action:string,entity_type:string>>"
    rows = [(1, text, [(0, 25, "MASK", "CUSTOM_TERM")]), (2, text, [(1, 3, "UNMASK", None), (2, 9, "MASK", "URL")]), (3, text, []), (4, text, None), (5, text, [(3, 5, "MASK", "URL")])]
    found = {r.id: r.o for r in spark.createDataFrame(rows, f"id long, text string, o {kind}").select("id", by_lines(F.col("o"), F.col("text")).alias("o")).collect()}
    assert [(o.start, o.end, text[o.start : o.end], o.action) for o in found[1]] == [(0, 3, "one", "MASK"), (7, 10, "two", "MASK"), (15, 25, "three four", "MASK")]
    assert [(text[o.start : o.end], o.action) for o in found[2]] == [("e", "MASK"), ("tw", "MASK")]
    assert found[3] == [] and found[4] is None and found[5] == []
