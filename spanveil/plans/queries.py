"""Queries over the given tables, each through the operators of this library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.scalars import html_escaped, html_text, luhn_valid, snippet
from spanveil.functions.matching import Rule
from spanveil.functions.spans import let
from spanveil.operators import images, reports, risk
from spanveil.operators.detect import candidates, detect, detected_values
from spanveil.operators import ocr, scans
from spanveil.operators.dictionary import learned_terms, match_terms, merged_terms
from spanveil.operators.edits import chunks, masked_more, purged, unmasked
from spanveil.operators.geometry import iou, rects_overlap
from spanveil.operators.mask import mask
from spanveil.operators.resolve import resolve
from spanveil.operators.reveal import decrypted, encrypted, revealed_text
from spanveil.operators.sessions import activity_sessions, rate_limited
from spanveil.operators.shield import session_id, shield
from spanveil.operators.votes import fuse_votes
from spanveil.rules import lines as lines_rules
from spanveil.rules import names, packs, regex, secret
from spanveil.storage import cut, spread, table

_ALL = {r.evidence: r for r in (*regex.RULES, *secret.RULES) if isinstance(r, Rule)}
EMAIL, CARD, IP, TOKEN = (_ALL[k] for k in ("e-mail address", "card number", "IP address", "assigned key or token"))
PLAIN = (EMAIL, CARD, IP, TOKEN)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _values(*rules: Rule) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detected_values(_docs(spark, sf_dir), rules).select("doc_id", "entity_type", "value")

    return query


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, entity_type, value) of the plain rules."""
    docs = _docs(spark, sf_dir)
    return detect(docs, PLAIN).select("doc_id", "lang", "source", F.explode("candidates").alias("s")).select("doc_id", "lang", "source", "s.entity_type", F.col("s.text").alias("value"))


def detect_card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detected_values(_docs(spark, sf_dir), (CARD,))
    return found.select("doc_id", "value", luhn_valid(F.col("value")).alias("luhn"))


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every default rule."""
    found = detect(_docs(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.explode("candidates").alias("s")).select("doc_id", "s.start", "s.end", "s.entity_type", "s.priority", F.col("s.text").alias("value"))


def entity_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(_entities(spark, sf_dir), "lang", "entity_type")


def entity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rollup_counts(_entities(spark, sf_dir), "lang", "entity_type")


def entity_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cube_counts(_entities(spark, sf_dir), "source", "entity_type")


def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_documents(_entities(spark, sf_dir), 10)


def distinct_types_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array_join(F.array_sort(F.collect_set("entity_type")), ",")
    return _entities(spark, sf_dir).groupBy("source").agg(types.alias("types"), F.countDistinct("value").alias("n_values"))


def risk_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(candidates(F.col("text"), PLAIN))
    rows = _docs(spark, sf_dir).select("doc_id", n.alias("n_entities")).withColumn("privacy_score", risk.privacy_score(F.col("n_entities")))
    return rows.select("doc_id", "n_entities", "privacy_score", (100 - F.col("privacy_score")).cast("int").alias("risk_score"), risk.risk_level(F.col("privacy_score"), F.lit(False)).alias("risk_level"))


def risk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all documents."""
    return reports.totals(risk_by_document(spark, sf_dir))


def score_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the privacy score of each language's documents."""
    scores = _docs(spark, sf_dir).select("lang", risk.privacy_score(F.size(candidates(F.col("text"), PLAIN))).alias("privacy_score"))
    return reports.percentiles(scores, "privacy_score", (0.1, 0.5, 0.9), "lang")


def risk_levels_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(candidates(F.col("text"), PLAIN))
    rows = _docs(spark, sf_dir).select("lang", risk.privacy_score(n).alias("score"))
    return rows.groupBy("lang", risk.risk_level(F.col("score"), F.lit(False)).alias("risk_level")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("score").alias("score_sum"))


def _masked(docs: DataFrame, rules: tuple[Rule, ...], **options) -> DataFrame:
    return mask(resolve(detect(docs, rules)), **options)


def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(_docs(spark, sf_dir).select("doc_id", "text"), (EMAIL,), strategy="REDACT").select("doc_id", "masked_text")


def hash_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct card numbers with the digests that stand for them."""
    found = _masked(_docs(spark, sf_dir).select("doc_id", "text"), (CARD,), spread=False).select("doc_id", F.explode("entities").alias("e"))
    return found.select("doc_id", F.col("e.text").alias("value"), F.concat(F.lit("[HASH_"), F.substring(F.sha2("e.text", 256), 1, 8), F.lit("]")).alias("digest"))


def placeholder_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of e-mail addresses, numbered by their first place in a document."""
    found = _masked(_docs(spark, sf_dir).select("doc_id", "text"), (EMAIL,)).select("doc_id", F.explode("entities").alias("e"))
    return found.select("doc_id", F.col("e.placeholder").alias("placeholder"), F.col("e.key").alias("key")).distinct()


def shield_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way for every document: masked text, scores, verdict."""
    out = shield(_docs(spark, sf_dir).select("doc_id", "text", "lang"))
    return out.select("doc_id", "lang", "session_id", "masked_text", "n_entities", "privacy_score", "risk_score", "shielded_score", "risk_level", "verdict", "decision", "summary")


def mask_reveal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked with plain rules, stored encrypted, decrypted and revealed: equal to the text."""
    out = _masked(_docs(spark, sf_dir).select("doc_id", "text"), PLAIN, case_exact=True)
    out = out.withColumn("stored", encrypted(F.col("mapping"), "fixture"))
    back = revealed_text(F.col("masked_text"), decrypted(F.col("stored"), "fixture"))
    return out.select("doc_id", F.coalesce(back == F.col("text"), F.col("text").isNull()).alias("lossless"))


def unmask_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses that stay masked after a document's first one was released by hand."""
    docs = detect(_docs(spark, sf_dir).select("doc_id", "text"), (EMAIL,)).where(F.size("candidates") > 0)
    first = F.element_at("candidates", 1)
    docs = docs.withColumn("overrides", F.array(F.struct(first["start"].alias("start"), first["end"].alias("end"), F.lit("UNMASK").alias("action"), F.lit(None).cast("string").alias("entity_type"))))
    return resolve(docs, overrides="overrides").select("doc_id", F.size("spans").alias("n_masked"))


def detect_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))
    return detected_values(pages, (EMAIL, IP), "page_id").select("page_id", "entity_type", "value")


def mask_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is one document: its turns in order."""
    turns = table(spark, sf_dir, "conversations")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    whole = turns.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("text"))
    return _masked(whole, (EMAIL, IP), strategy="REDACT").select("conv_id", "masked_text")


def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three words of benchmark items as terms, found in the documents."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}_&'-]+"), F.lit(0))
    terms = table(spark, sf_dir, "benchmark").where(F.size(words) >= 3).select(F.array_join(F.slice(words, 1, 3), " ").alias("term"), F.lit("CUSTOM_TERM").alias("entity_type"), F.lit("custom").alias("tier"))
    found = match_terms(_docs(spark, sf_dir), terms)
    return found.groupBy(F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_documents"))


def dictionary_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations, regions and suppliers as terms of three tiers: the first tier that has a name keeps it."""
    part = lambda name, column, kind, tier: table(spark, sf_dir, name).select(F.col(column).alias("term"), F.lit(kind).alias("entity_type"), F.lit(tier).alias("tier"))
    nations, regions = part("nation", "n_name", "LOCATION", "industry"), part("region", "r_name", "LOCATION", "team")
    merged = merged_terms(nations.unionByName(regions).unionByName(part("nation", "n_name", "CUSTOM_TERM", "custom")).unionByName(part("supplier", "s_name", "ORGANIZATION", "org")))
    return merged.groupBy("tier", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = activity_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 60)
    return found.select("user_id", "session_no", "n_events", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("expires_at").cast("timestamp")).alias("expires_us"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=3, seconds=3600)


def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked documents whose beginning, source or language has a search text."""
    docs = _docs(spark, sf_dir)
    n = F.size(candidates(F.col("text"), PLAIN))
    audit = docs.select("doc_id", "source", "lang", snippet(F.col("text")).alias("snippet"), F.when(n > 0, "MASKED").otherwise("PASSED").alias("decision"))
    return reports.search(audit, "EN", ("snippet", "source", "lang"), "MASKED").select("doc_id", "source", "lang", "snippet")


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest events (a limit is the feature)."""
    events = table(spark, sf_dir, "events")
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "user_id", "event_type")


def escaped_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", snippet(html_escaped(F.col("html"))).alias("snippet"))


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes derived from order lines: pairs within an order that overlap."""
    lines = table(spark, sf_dir, "lineitem")
    boxes = lines.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 5).alias("width"), (F.col("l_linenumber") * 2.0).alias("height"))
    side = lambda n: boxes.select("l_orderkey", *[F.col(c).alias(f"{c}_{n}") for c in ("l_linenumber", "x", "y", "width", "height")])
    a, b = ({c: F.col(f"{c}_{n}") for c in ("x", "y", "width", "height")} for n in "ab")
    met = side("a").join(side("b"), "l_orderkey").where("l_linenumber_a < l_linenumber_b").where(rects_overlap(a, b))
    return met.select("l_orderkey", F.col("l_linenumber_a").alias("line_a"), F.col("l_linenumber_b").alias("line_b"), F.round(iou(a, b), 6).alias("iou"))


def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", session_id(F.col("doc_id"), F.col("text")).alias("session_id"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(_docs(spark, sf_dir))


def fused_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as votes on stretches of their order."""
    start = F.col("l_linenumber") * 4
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("start"), (start + 2 + F.col("l_suppkey") % 5).alias("end"), F.col("l_returnflag").alias("entity_type"), (0.5 + F.col("l_discount")).alias("confidence"))
    out = fuse_votes(lines, "l_orderkey")
    return out.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long"), "confidence": F.round("confidence", 6)})


def pack_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(*packs.pack_rules())(spark, sf_dir)


def learned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IP addresses and e-mail addresses that several documents have."""
    found = detected_values(_docs(spark, sf_dir), (EMAIL, IP))
    return learned_terms(found).select("term", "entity_type", "n_docs")


def purged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("mapping"), "lang")
    return purged(docs, F.col("lang") == "en").select("doc_id", F.coalesce(F.length("mapping"), F.lit(0)).cast("long").alias("n_chars"), "is_purged")


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's name hidden in the text afterwards, and shown again."""
    docs = _docs(spark, sf_dir).where("text IS NOT NULL").withColumn("word", F.coalesce(F.regexp_extract("text", "[A-Za-z]{4,}", 0), F.lit("")))
    hidden = docs.withColumn("hidden", masked_more(F.col("text"), F.col("word"), F.lit("[[CUSTOM_TERM_001]]")))
    shown = unmasked(F.col("hidden"), F.lit("[[CUSTOM_TERM_001]]"), F.col("word"))
    return hidden.select("doc_id", F.length("hidden").cast("long").alias("n_hidden"), (shown == F.col("text")).alias("restored"))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of documents, dealt by id: what groups or joins by document what is made of them moves none of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a number that is asked for stays: parts of texts grow tenfold as words or pixels
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * docs.rdd.getNumPartitions())
    return docs.repartition(parts, "doc_id")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as images of ten words a line."""
    docs = _dealt(spark, sf_dir)
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("at", "text"))
    line = F.floor(F.col("at") / 10).cast("int")
    width = F.least(F.length("text") * 8.0, F.lit(78.0))
    return words.select("doc_id", line.alias("line_no"), (F.col("at") % 10).cast("int").alias("word_no"), "text", (F.col("at") % 10 * 80.0).alias("x"), (line * 20.0).alias("y"), width.alias("width"), F.lit(16.0).alias("height"))


def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.image_text(_words(spark, sf_dir), "doc_id")


def ocr_entity_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the stretches 10 to 120 and 200 to 210 of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(800.0).alias("w"), F.lit(10_000.0).alias("h"))
    stretches = F.array(*[F.struct(F.lit(i).alias("entity_id"), F.lit(a).alias("start"), F.lit(b).alias("end")) for i, a, b in ((1, 10, 120), (2, 200, 210))])
    entities = docs.select("*", F.inline(stretches))
    return ocr.entity_boxes(entities, ocr.text_offsets(_words(spark, sf_dir), "doc_id"), "doc_id", size=("w", "h"))


def ocr_phrase_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other places of the two words at the top of each document."""
    words = _words(spark, sf_dir)
    boxes = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("box_id"), *[F.lit(v).alias(n) for n, v in zip(ocr.RECT, (0.0, 0.0, 159.0, 16.0), strict=True)])
    phrases = ocr.text_under(boxes, words, "doc_id").withColumnRenamed("box_id", "phrase_id")
    found = ocr.uncovered(ocr.phrase_boxes(phrases, words, "doc_id"), boxes, "doc_id")
    return found.select("doc_id", "line_no", "word_no", "x", "y", "width", "height")


def image_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each text as the pixels of an image of three rows, of which two boxes are hidden and put back."""
    drawn = lambda docs: docs.where("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("body")).withColumn("w", F.length("body"))
    half = F.floor(F.col("w") / 2).cast("double")
    box = lambda name, *rect: F.struct(F.lit(name).alias("box_id"), *[F.lit(v).cast("double").alias(n) for n, v in zip(ocr.RECT, rect, strict=True)])
    boxes = drawn(table(spark, sf_dir, "documents")).select("doc_id", F.inline(F.array(box("a", 0, 0, F.greatest(half, F.lit(1.0)), 2), box("b", half, 2, F.col("w"), 1))))
    boxes = boxes.select("*", F.lit("CUSTOM").alias("entity_type"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("placeholder"))
    # both sides of the meeting below come from it: images are hidden once
    hidden = images.shield_images(drawn(_dealt(spark, sf_dir)), boxes, "key", "doc_id", images.png_of(F.concat(*12 * ["body"]), F.col("w"), 4), as_text=False)
    shielded = cut(hidden.select("doc_id", "session_id", "shielded", "encrypted_mappings"))
    kept = shielded.select("session_id", "encrypted_mappings", F.lit(1).alias("expires_at"), F.lit(False).alias("is_purged"))
    # in as many parts as they were made in: a task holds its images' pixels twice
    sent = shielded.select("doc_id", "session_id", "shielded").repartition(shielded.rdd.getNumPartitions(), "session_id")
    seen = images.reveal_images(sent, kept, "key", F.lit(0), "shielded")
    shown = seen.select("doc_id", "status", "n_restored", images.png_pixels(F.col("shielded")).alias("before"), images.png_pixels(F.col("restored")).alias("after"))
    return shown.select("doc_id", "status", F.col("n_restored").cast("long").alias("n_restored"), F.col("after.width").cast("long").alias("width"), (F.col("before.rgba") != F.col("after.rgba")).alias("hidden"), F.sha2("after.rgba", 256).alias("restored_sha256"))


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as vector graphics: a text element for each line that isn't blank, lower and larger from line to line."""
    docs = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = docs.select("doc_id", F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("text"))
    line = lambda t, i: F.concat(F.lit('<text x="'), (i % 7 + 5).cast("string"), F.lit('" y="'), (20 * (i + 1)).cast("string"), F.lit('" font-size="'), (10 + i % 5).cast("string"), F.lit('">'), t, F.lit("</text>"))
    return coded.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "").alias("svg"))


def svg_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and their places, read from documents drawn as vector graphics: one row a line with its last word."""
    lines = scans.svg_lines(_markup(spark, sf_dir), "doc_id")
    # words stay on their line: none is moved to be counted
    ends = lines.select("doc_id", "line_no", let(F.col("words"), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.element_at(ws, -1).alias("w"))).alias("e"))
    return ends.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "e.n_words", F.col("e.w.text").alias("last_word"), *[F.col(f"e.w.rect.{n}").alias(n) for n in ocr.RECT])


def json_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents laid out as recognised pages in JSON of half the size, at their places on the image: one row a line."""
    words = _words(spark, sf_dir)
    bbox = F.struct((F.col("x") / 2).alias("x0"), (F.col("y") / 2).alias("y0"), ((F.col("x") + F.col("width")) / 2).alias("x1"), ((F.col("y") + F.col("height")) / 2).alias("y1"))
    lines = words.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_no", F.struct("text", bbox.alias("bbox")).alias("w")))).alias("ws"))
    text = F.array_join(F.transform("ws", lambda w: w["w"]["text"]), " ")
    pages = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.struct(text.alias("text"), F.transform("ws", lambda w: w["w"]).alias("words")).alias("line")))).alias("ls"))
    pages = pages.select("doc_id", F.to_json(F.struct(F.transform("ls", lambda x: x["line"]).alias("lines"))).alias("page"), F.lit(100_000).alias("width"), F.lit(1_000_000).alias("height"), F.lit(2.0).alias("scale"))
    found = scans.json_words(pages, "doc_id", scale="scale")
    # lines count from one anew; what counts is what stands on them
    return found.groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("n_words"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "n_words", "x", "y", "right")


def continued_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes down a page, with a placeholder for each of two suppliers: which continue the one before."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    boxes = lines.select("l_orderkey", F.col("l_linenumber").alias("box_no"), F.lit("API_KEY").alias("entity_type"), F.concat(F.lit("[[API_KEY_00"), (F.col("l_suppkey") % 2).cast("string"), F.lit("]]")).alias("placeholder"), F.lit(None).cast("string").alias("evidence"), (F.col("l_partkey") % 90).cast("double").alias("x"), (F.col("l_linenumber") * 25).cast("double").alias("y"), F.lit(30.0).alias("width"), F.lit(20.0).alias("height"))
    found = scans.continued_boxes(boxes, "l_orderkey")
    return found.select("l_orderkey", F.col("box_no").cast("long").alias("box_no"), "placeholder", "continues", "chain_no")


def fallback_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last word of each text, looked for on the lines without their offsets: how they were found."""
    words = _words(spark, sf_dir)
    docs = _docs(spark, sf_dir).select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("ws")).where("size(ws) > 0")
    ends = docs.select("doc_id", F.posexplode(F.array(F.element_at("ws", 1), F.element_at("ws", -1))).alias("entity_id", "text"), F.lit(100_000).alias("width"), F.lit(1_000_000).alias("height"))
    return scans.fallback_boxes(ends, words, "doc_id").select("doc_id", F.col("entity_id").cast("long").alias("entity_id"), "how")


#: Given names and surnames that orders are signed with.
SIGNERS = tuple((g, n) for g, n in zip(names.GIVEN.split()[:60:2], names.SURNAMES.split()[:60:2], strict=True) if g.isascii())


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as letters: who signs follows from the customer, what stands before from the order."""
    of = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in SIGNERS]), (F.col("o_custkey") % len(SIGNERS) + 1).cast("int"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" was packed and then seen by "), of(0), F.lit(" "), of(1), F.lit(" on the way\n")).alias("text"))


def name_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons that the lists of names find in the letters of all orders."""
    found = detected_values(_signed(spark, sf_dir), (names.READER,), "o_orderkey")
    return found.select("o_orderkey", F.col("start").cast("long").alias("start"), "entity_type", "value")


def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of forms made of all customers: which lines are fields, of which type, and where their values stand."""
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    lines = [("Employer", F.col("c_mktsegment")), ("Country", F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))), ("Result", F.lit("done")), ("Badge", F.concat(F.lit("B-"), F.col("c_custkey").cast("string"))), ("Fee", F.lit("$12.50 USD")), ("Favourite Colour", F.concat(F.lit("c"), (F.col("c_custkey") % 7).cast("string"), F.lit(", please keep it")))]
    forms = customers.select("c_custkey", F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), value) for label, value in lines]).alias("text"))
    found = detect(forms, (lines_rules.READER,)).select("c_custkey", F.explode("candidates").alias("s"))
    return found.select("c_custkey", F.col("s.start").cast("long").alias("start"), "s.entity_type", "s.prefix", F.col("s.text").alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "detect_email": _values(EMAIL),
    "detect_ipv4": _values(IP),
    "detect_token": _values(TOKEN),
    **{
        f.__name__: f
        for f in (
            detect_card_luhn, detect_all, entity_counts_by_lang, entity_rollup, entity_cube, top_documents, distinct_types_by_source, risk_by_document,
            risk_levels_by_lang, mask_email, hash_cards, placeholder_numbers, shield_documents, mask_reveal_roundtrip, unmask_first, detect_in_pages,
            mask_conversations, dictionary_matches, dictionary_tiers, session_ttl, rate_limit, audit_search, recent_history, escaped_snippets, box_overlaps, session_ids,
            risk_totals, text_chunks, fused_votes, pack_values, learned_values, purged_documents, edited_documents, ocr_text, ocr_entity_boxes, ocr_phrase_boxes,
        )
    },
    "image_reveal": image_reveal,
    **{f.__name__: f for f in (svg_words, json_words, continued_boxes, fallback_boxes, name_values, form_values, score_percentiles)},
}
