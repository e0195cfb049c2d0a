"""Terms of users and domains: looked up word by word where texts are read, or, for large dictionaries, joined on runs of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.matching import Reader
from spanveil.functions.spans import staged
from spanveil.types import DICTIONARY_PRIORITY, SPAN

#: A tier that claims a term keeps it; earlier tiers first.
TIERS = ("enterprise", "custom", "industry", "user", "team", "org")
# Domain packs, the usual type of their terms, terms, terms of other types.
PACKS = {
    "HEALTHCARE_PHI": ("MEDICAL_RECORD", ("Protected Health Information", "Electronic Health Record", "ICD-10-CM", "HIPAA Identifier", "Medical Record Number", "MRN Patient", "Clinical Trial Subject", "Prescription Rx Number", "Patient History Record")),
    "FINANCE_MNPI": ("FINANCIAL_METRIC", ("Material Non-Public Information", "MNPI Disclosure", "Offshore Ledger Account", "Wire Transfer Settlement", "Insider Trading Window", "Merger & Acquisition Codename", "EBITDA Guidance", "Q4 Revenue Forecast")),
    "LEGAL_PRIVILEGE": ("LEGAL_REFERENCE", ("Attorney-Client Privileged", "Work Product Doctrine", "Confidential Disclosure Agreement", "Trade Secret Classification", "Subject to NDA", "Court Sealed File", "Under Protective Order")),
    "CYBER_DEVOPS": ("COMPANY_SECRET", ("Staging DB Cluster", "K8s Secret Manifest", "Internal Gateway Route", "Production Root Credential", "AWS IAM Master Role")),
    "GOVT_DEFENSE": ("COMPANY_SECRET", ("TOP SECRET // NOFORN", "Controlled Unclassified Information", "Sensitive Compartmented Information", "ITAR Restricted Technical Data", "Special Access Program")),
}
OTHER_TYPES = {
    "Merger & Acquisition Codename": "PROJECT_CODENAME", "Trade Secret Classification": "COMPANY_SECRET", "K8s Secret Manifest": "API_KEY",
    "Production Root Credential": "PASSWORD", "AWS IAM Master Role": "API_KEY",
}
_WORD = r"[\p{L}\p{N}_&'-]+"
_PY_WORD = re.compile(r"(?:[^\W_]|[_&'-])+")
#: A dictionary up to so many rows may be sent to every executor.
SMALL = 50_000


def words_key(text: Column) -> Column:
    """Words in lower case with one space between them."""
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), " "))


def pack_terms(spark, enabled: tuple[str, ...] = tuple(PACKS), own: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(term, entity_type, tier, pack_id) of one's own terms (term, type) and the enabled packs."""
    rows = [(term, kind, "enterprise", None) for term, kind in own]
    rows += [(term, OTHER_TYPES.get(term, PACKS[pack][0]), "industry", pack) for pack in enabled for term in PACKS[pack][1]]
    return spark.createDataFrame(rows, "term string, entity_type string, tier string, pack_id string")


def learned_terms(found: DataFrame, least: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(term, entity_type, tier, n_docs) of the ``found`` values (id, entity_type, value) that at least so many documents have."""
    seen = found.groupBy(F.col("value").alias("term"), "entity_type").agg(F.count_distinct(id_col).alias("n_docs"))
    return seen.where(F.col("n_docs") >= least).select("term", "entity_type", F.lit("custom").alias("tier"), "n_docs")


def merged_terms(terms: DataFrame) -> DataFrame:
    """(term_key, term, entity_type, tier): for each term the first tier that claims it."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    order = Window.partitionBy("term_key").orderBy(F.when(rank == 0, len(TIERS) + 1).otherwise(rank), "term", "entity_type")
    keyed = terms.withColumn("term_key", words_key(F.col("term"))).where("term_key <> ''")
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("term_key", "term", "entity_type", "tier")


class TermFinder:
    """Terms looked up at every word of a text, longest or not: a detector for texts in Arrow batches.

    ``terms``: (term_key, term, entity_type, tier). A term stands where its words follow
    one another with nothing but other characters between.
    """

    def __init__(self, terms: list[tuple[str, str, str, str]]):
        self.terms = {key: (term, kind, tier) for key, term, kind, tier in terms}
        self.sizes: dict[str, set[int]] = {}
        for key in self.terms:
            self.sizes.setdefault(key.split(" ", 1)[0], set()).add(key.count(" ") + 1)

    def places(self, text: str) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, term, entity_type, tier)."""
        words = [(m.group().lower(), m.start(), m.end()) for m in _PY_WORD.finditer(text)]
        for k, (word, start, _) in enumerate(words):
            for n in self.sizes.get(word, ()):
                if k + n <= len(words) and (found := self.terms.get(" ".join(w for w, _, _ in words[k : k + n]))):
                    yield start, words[k + n - 1][2], *found

    def __call__(self, text: str) -> Iterator[tuple]:
        for start, end, _, kind, tier in self.places(text):
            yield start, end, kind, 1.0, DICTIONARY_PRIORITY, f"term of the {tier} dictionary", None


def term_reader(terms: DataFrame) -> Reader | None:
    """A detector of the ``terms``, or null if they are more than SMALL and must be joined."""
    rows = merged_terms(terms).limit(SMALL + 1).collect()
    return None if len(rows) > SMALL else Reader("dictionary", TermFinder([tuple(r) for r in rows]))


def _text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def term_places(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, places) of each of the ``texts`` (key, text, each text once) with terms; places: (start, end, term, entity_type, tier, value).

    Every run of words that is as long as some term is a candidate; candidates meet
    the terms in an equi join, and the text goes along by its key, not by an id that
    rows may share or lack. For dictionaries of any size.
    """
    merged = merged_terms(terms)
    sizes = sorted(r.n for r in merged.select(F.size(F.split("term_key", " ")).alias("n")).distinct().collect())
    words = staged(texts, _words=F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).select("key", "_words")

    def runs(n: int) -> Column:
        starts = F.slice("_words", 1, F.greatest(F.size("_words") - (n - 1), F.lit(0)))
        return starts if n == 1 else F.transform(starts, lambda w, i: F.array_join(F.slice("_words", (i + 1).cast("int"), n), " "))

    every = F.array_distinct(F.concat(*[runs(n) for n in sizes])) if sizes else F.array().cast("array<string>")
    met = words.select("key", F.explode(every).alias("term_key")).join(merged, "term_key")
    own = met.groupBy("key").agg(F.collect_list(F.struct("term_key", "term", "entity_type", "tier")).alias("terms"))

    def locate(bodies: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, terms in zip(bodies.to_pylist(), found.to_pylist(), strict=True):
            finder = TermFinder([tuple(t.values()) for t in terms])
            out.append([dict(zip(_PLACE, (*p, text[p[0] : p[1]]), strict=True)) for p in finder.places(text)])
        return pa.array(out, pa.list_(pa.struct([(n, pa.int32() if n in ("start", "end") else pa.string()) for n in _PLACE])))

    kind = ",".join(f"{n}:{'int' if n in ('start', 'end') else 'string'}" for n in _PLACE)
    return own.join(texts, "key").select("key", F.arrow_udf(locate, f"array<struct<{kind}>>")("text", "terms").alias("places"))


_PLACE = ("start", "end", "term", "entity_type", "tier", "value")


def with_terms(docs: DataFrame, terms: DataFrame, text: str = "text", column: str = "term_spans") -> DataFrame:
    """``docs`` with array<SPAN> of a dictionary too large to send to every task. Each row gets its text's places, whatever its id."""
    keyed = docs.withColumn("_key", _text_key(F.col(text)))
    texts = keyed.select(F.col("_key").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("text <> ''").dropDuplicates(["key"])
    span = lambda p, i: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), p["entity_type"].alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit(DICTIONARY_PRIORITY).alias("priority"), F.lit("dictionary").alias("detector"),
        F.concat(F.lit("term of the "), p["tier"], F.lit(" dictionary")).alias("evidence"), p["value"].alias("text"), F.lit(None).cast("string").alias("prefix"), i.cast("int").alias("seq"),
    ).cast(SPAN)
    found = term_places(texts, terms).select(F.col("key").alias("_key"), F.transform("places", span).alias(column))
    none = F.array().cast(f"array<{SPAN}>")
    return keyed.join(found, "_key", "left").withColumn(column, F.coalesce(column, none)).drop("_key")


def match_terms(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end, term, entity_type, value) of each place where a term stands as whole words.

    A dictionary up to SMALL rows goes to every task, and texts are read once where
    they are; a larger one is joined. Rows keep their own ids, repeated or null.
    """
    rows = merged_terms(terms).limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        keyed = docs.select(id_col, _text_key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("text <> ''")
        found = keyed.drop("text").join(term_places(keyed.select("key", "text").dropDuplicates(["key"]), terms), "key").select(id_col, F.inline("places"))
        return found.select(id_col, "start", "end", "term", "entity_type", "value")
    finder = TermFinder([tuple(r) for r in rows])

    def read(texts: pa.Array) -> pa.Array:
        out = [[{"start": s, "end": e, "term": t, "entity_type": k, "value": x[s:e]} for s, e, t, k, _ in finder.places(x)] for x in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("entity_type", pa.string()), ("value", pa.string())])))

    places = F.arrow_udf(read, "array<struct<start:int,end:int,term:string,entity_type:string,value:string>>").asNondeterministic()
    return docs.select(id_col, places(F.coalesce(F.col(text), F.lit(""))).alias("p")).select(id_col, F.inline("p"))
