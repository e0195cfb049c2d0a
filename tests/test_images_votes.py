"""OCR tables, vote fusion, later edits, packs: small tables with known results."""

from pyspark.sql import functions as F

from spanveil.functions.matching import find_all
from spanveil.functions.scalars import iban_format
from spanveil.operators import ocr, reports
from spanveil.operators.dictionary import PACKS, learned_terms, match_terms, pack_terms
from spanveil.operators.edits import chunks, masked_more, purged, unmasked
from spanveil.operators.votes import fuse_votes
from spanveil.rules.packs import PATTERNS, pack_rules

WORDS = "image_id long, line_no int, word_no int, text string, x double, y double, width double, height double"
ROWS = [
    (1, 0, 0, "Ann", 0.0, 0.0, 30.0, 10.0), (1, 0, 1, "Lee,", 40.0, 0.0, 30.0, 10.0), (1, 0, 2, "signed", 80.0, 0.0, 60.0, 10.0),
    (1, 1, 0, "for", 0.0, 20.0, 30.0, 10.0), (1, 1, 1, "ann", 40.0, 20.0, 30.0, 10.0), (1, 1, 2, "lee", 80.0, 20.0, 30.0, 10.0), (2, 0, 0, "Ann", 0.0, 0.0, 30.0, 10.0),
]


def test_offsets_agree_with_text(spark):
    words = spark.createDataFrame(ROWS, WORDS)
    texts = {r.image_id: r.text for r in ocr.image_text(words).collect()}
    assert texts == {1: "Ann Lee, signed\nfor ann lee", 2: "Ann"}
    assert all(texts[r.image_id][r.start : r.end] == r.text for r in ocr.text_offsets(words).collect())


def test_boxes_of_an_entity_on_two_lines(spark):
    words = ocr.text_offsets(spark.createDataFrame(ROWS, WORDS))
    entity = spark.createDataFrame([(1, 7, 9, 19), (1, 8, 0, 0)], "image_id long, entity_id int, start int, end int")
    found = sorted(map(tuple, ocr.entity_boxes(entity, words, padding=1.0).collect()))
    assert found == [(1, 7, 0, 79.0, -1.0, 62.0, 12.0), (1, 7, 1, -1.0, 19.0, 32.0, 12.0)]


def test_phrase_under_a_box_is_found_elsewhere(spark):
    words = spark.createDataFrame(ROWS, WORDS)
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 70.0, 10.0), (3, 1, 0.0, 0.0, 9.0, 9.0)], "image_id long, box_id int, x double, y double, width double, height double")
    under = ocr.text_under(boxes, words)
    assert [tuple(r) for r in under.collect()] == [(1, 1, "Ann Lee,")]
    places = ocr.phrase_boxes(under.withColumnRenamed("box_id", "phrase_id"), words)
    assert sorted((r.line_no, r.word_no) for r in places.collect()) == [(0, 0), (1, 1)]
    assert [tuple(r) for r in ocr.uncovered(places, boxes).collect()] == [(1, 1, 1, 1, 40.0, 20.0, 70.0, 10.0)]


def test_tsv(spark):
    tsv = "level\tpage_num\tb\tp\tl\tw\tleft\ttop\twidth\theight\tconf\ttext\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t1\t5\t6\t7\t8\t91.5\tHi\r\n5\t1\t2\t1\t1\t1\t1\t2\t3\t4\t80\tyou\n5\t1\t2\t1\t1\t2\t1\t2\t3\t4\t80\t \n"
    rows = ocr.tsv_words(spark.createDataFrame([(1, tsv), (2, None), (3, "")], "image_id long, tsv string")).orderBy("line_no").collect()
    assert [(r.image_id, r.line_no, r.word_no, r.text, r.x, r.height, r.confidence) for r in rows] == [(1, 1, 1, "Hi", 5.0, 8.0, 91.5), (1, 2, 1, "you", 1.0, 4.0, 80.0)]


def test_image_size_and_scale(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    gif = b"GIF89a" + (320).to_bytes(2, "little") + (200).to_bytes(2, "little")
    bmp = b"BM" + bytes(16) + (70_000).to_bytes(4, "little") + (9).to_bytes(4, "little")
    rows = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate((png, gif, bmp, b"", None))], "i int, data binary")
    sizes = [r.s and tuple(r.s) for r in rows.orderBy("i").select(ocr.image_size(F.col("data")).alias("s")).collect()]
    assert sizes == [(640, 480), (320, 200), (70_000, 9), None, None]
    sides = spark.createDataFrame([(4000, 1000), (1000, 200), (1000, 100), (550, 450), (0, 5), (1000, 900)], "w int, h int")
    assert [r.s for r in sides.select(ocr.scale_factor(F.col("w"), F.col("h")).alias("s")).collect()] == [0.5, 2.0, 3.0, 600 / 550, 1.0, 1.0]


def test_votes(spark):
    votes = [(1, 0, 5, "A", 0.8), (1, 4, 9, "B", 0.82), (1, 8, 12, "A", 0.7), (1, 12, 14, "C", 0.5), (None, 0, 1, "A", 0.98), (None, 0, 1, "A", 0.98)]
    found = fuse_votes(spark.createDataFrame(votes, "doc_id long, start int, end int, entity_type string, confidence double")).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(1, 0, 12, "A", 0.83, 2), (1, 12, 14, "C", 0.5, 1), (None, 0, 1, "A", 0.99, 2)]))


def test_edits(spark):
    row = spark.createDataFrame([("x [[A_001]] y [[A_001]] x", "[[A_001]]", "v")], "m string, p string, v string")
    assert row.select(unmasked(F.col("m"), F.col("p"), F.col("v"))).first()[0] == "x v y v x"
    assert row.select(masked_more(F.col("m"), F.lit("x"), F.lit("[[B_001]]"))).first()[0] == "[[B_001]] [[A_001]] y [[A_001]] [[B_001]]"
    assert row.select(masked_more(F.col("m"), F.lit(""), F.lit("[[B_001]]"))).first()[0] == row.first()[0]
    docs = spark.createDataFrame([(1, "a  b"), (2, ""), (3, None)], "doc_id int, text string")
    assert sorted(map(tuple, chunks(docs).collect())) == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, "")]
    sessions = spark.createDataFrame([(1, "m", False), (2, "n", True), (None, "o", None)], "id int, mapping string, is_purged boolean")
    assert [tuple(r) for r in purged(sessions, F.col("id") == 1).collect()] == [(1, None, True), (2, "n", True), (None, "o", False)]


def test_packs(spark):
    text = "MRN-1234567 ICD-10-E119 rx #12345678 DEUTDEFF500 CUSIP 037833100 db.internal printer.local TOP  SECRET CUI//SP-PRVCY confidential attorney-client privileged"
    kinds = {d["text"]: d["entity_type"] for d in find_all(text, pack_rules())}
    assert kinds == {
        "MRN-1234567": "MEDICAL_RECORD", "ICD-10-E119": "MEDICAL_RECORD", "rx #12345678": "MEDICAL_RECORD", "DEUTDEFF500": "FINANCIAL_METRIC", "CUSIP 037833100": "FINANCIAL_METRIC",
        "db.internal": "URL", "printer.local": "URL", "TOP  SECRET": "COMPANY_SECRET", "CUI//SP-PRVCY": "COMPANY_SECRET", "confidential attorney-client privileged": "LEGAL_REFERENCE",
    }
    assert set(PACKS) == set(PATTERNS) and find_all(text, pack_rules(("LEGAL_PRIVILEGE",)))[0]["entity_type"] == "LEGAL_REFERENCE"
    docs = spark.createDataFrame([(1, "The aws iam master role is TOP SECRET // NOFORN."), (2, None)], "doc_id int, text string")
    assert {(r.doc_id, r.entity_type) for r in match_terms(docs, pack_terms(spark)).collect()} == {(1, "API_KEY"), (1, "COMPANY_SECRET")}


def test_learned_terms(spark):
    found = spark.createDataFrame([(1, "PERSON_NAME", "Ann"), (1, "PERSON_NAME", "Ann"), (2, "PERSON_NAME", "Ann"), (2, "PERSON_NAME", "Bo")], "doc_id int, entity_type string, value string")
    assert [tuple(r) for r in learned_terms(found).collect()] == [("Ann", "PERSON_NAME", "custom", 2)]


def test_totals_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id int, n_entities int, privacy_score int")
    assert [tuple(r) for r in reports.totals(none).collect()] == [(0, 0, None, None)]


def test_iban_format(spark):
    rows = spark.createDataFrame([("DE89 3704 0044 0532 0130 00",), ("DE89",), ("de89370400440532013000",), (None,)], "v string")
    assert [r.ok for r in rows.select(iban_format(F.col("v")).alias("ok")).collect()] == [True, False, False, None]


def test_words_that_have_a_phrase_in_them(spark):
    from spanveil.operators.ocr import word_boxes

    words = spark.createDataFrame([(1, 0, k, t, 10.0 * k, 0.0, 9.0, 9.0) for k, t in enumerate(["Falcon,", "falconry", "FAL", "fall", "(fal)", "key=FALCON-2", "x"])] + [(2, 0, 0, "falcon", 0.0, 0.0, 9.0, 9.0)], "image_id long, line_no int, word_no int, text string, x double, y double, width double, height double")
    phrases = spark.createDataFrame([(1, 1, "falcon"), (1, 2, "Fal"), (1, 3, "two words"), (1, 4, "--"), (1, 5, "falconry!")], "image_id long, phrase_id int, phrase string")
    found = {(r.word_no, r.phrase_id) for r in word_boxes(phrases, words).collect()}
    assert found == {(0, 1), (1, 5), (2, 2), (4, 2), (5, 1)}


def test_percentiles(spark):
    from spanveil.operators.reports import percentiles

    rows = spark.createDataFrame([("a", k) for k in range(101)] + [("b", 7), ("b", None)], "lang string, score int")
    out = {r.lang: (r.p50, r.p90, r.p99_5) for r in percentiles(rows, "score", (0.5, 0.9, 0.995), "lang").collect()}
    assert out == {"a": (50.0, 90.0, 99.5), "b": (7.0, 7.0, 7.0)}
    near = percentiles(rows, "score", (0.5,), accuracy=1000).first().p50
    assert abs(near - 50) <= 1 and percentiles(rows.limit(0), "score").first().p50 is None
