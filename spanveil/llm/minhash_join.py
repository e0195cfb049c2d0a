"""Near-duplicate documents by b-bit MinHash signatures and a multi-index Hamming join.

A signature has one ``BITS``-bit symbol for each of ``SYMBOLS`` hash functions: of the
smallest hash of the document's n-grams. Two signatures differ in about
(1 - similarity) of their symbols; pairs count as alike when they differ in
``threshold(...)`` symbols at most, a bound that a pair at the similarity asked for
exceeds about once in a million times.

The join of all pairs under that bound goes by pigeonhole. Signatures are cut into so
many chunks that the errors can't be two or more in all chunks but one: so at least
two chunks of a pair have one error at most. The allowed errors are enumerated: a
chunk is looked up once for each of its symbols, that symbol left out, so two chunks
with at most one error meet under a common key whichever symbol differs. Every pair
within the bound therefore meets under a key, and under a second one of another
chunk, which cuts keys of very many documents: their documents meet under pairs of
keys instead.

Documents with equal sets are one class and take part once. Under a key, documents
first meet only the smallest one and the one before them; then only those that are
still in different components meet, inside tasks. Met pairs within the bound are
confirmed on their full sets of n-grams, and components follow from confirmed links.

Defined cases: a null or empty text, or one without words, has no n-grams, and is
linked with nothing; with fewer than ``n`` words the whole sequence is the only
n-gram; a text of any length is read whole; rows with a null id have a set but no
component (null); rows that repeat an id are one vertex; an empty table gives no
rows; only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.components import cut_to_size
from spanveil.llm.ngram_join import (
    PAIRS_A_TASK,
    POSTING_ROWS,
    TRIES,
    _KEYS,
    NgramHasher,
    _block_meetings,
    _body,
    _differ,
    _distinct,
    _folded,
    _joined,
    _live_postings,
    _met_keys,
    _mix,
    _pair,
    _parts,
    _possible,
    _unlike,
)
from spanveil.llm.repeats import look_up
from spanveil.storage import cut

#: Hash functions, and bits kept of each smallest hash.
SYMBOLS, BITS = 64, 16
#: A pair at the similarity asked for differs in more symbols than the threshold this rarely.
MISS = 2e-6
#: Keys are counted in so many counters; a counter's keys are common above twice the mean and so many rows.
COUNTERS = 1 << 14
#: No n-gram comes last in the order in which fragments are cut: the order plays no part here.
_PLAIN = (bytes(1), bytes(1))
_U = np.uint64
_SKETCH_BITS = 256


def threshold(num: int, den: int) -> int:
    """Symbols in which pairs of similarity num / den differ at most, but for a share of MISS."""
    apart = (1 - num / den) * (1 - 2.0**-BITS)
    chance = [comb(SYMBOLS, k) * apart**k * (1 - apart) ** (SYMBOLS - k) for k in range(SYMBOLS + 1)]
    return next(t for t in range(SYMBOLS + 1) if sum(chance[t + 1 :]) <= MISS)


def chunks_for(most: int) -> list[tuple[int, int]]:
    """(begin, end) of chunks of which two have one error at most, whenever there are ``most`` errors in all.

    With m chunks, of which one only has less than two errors, there are 2 * (m - 1) at least.
    """
    m = min(most // 2 + 2, SYMBOLS // 2)
    if 2 * (m - 1) <= most:
        raise ValueError("the similarity is too low for so few symbols")
    edges = [k * SYMBOLS // m for k in range(m + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _signatures(text: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """A row of symbols for each text: a part of its smallest hash under each function."""
    multipliers = _mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | _U(1)
    least = np.zeros((rows, SYMBOLS), np.uint16)
    some = np.unique(text)
    if len(some):
        begins, mixed = np.searchsorted(text, some), _mix(key)
        for k, m in enumerate(multipliers):
            least[some, k] = (_mix(np.minimum.reduceat(mixed * m, begins)) >> _U(64 - BITS)).astype(np.uint16)
    return least


def signed_sets(body: DataFrame, n: int) -> DataFrame:
    """(id, n, d1, d2, signature, sketch): each set's size, digests, signature and parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = NgramHasher(n)
        for rows, part in _parts(batches, 1):
            text, key = _distinct(*hasher(part))
            size = np.bincount(text, minlength=len(part))
            m = _mix(key)
            begins, some = (np.cumsum(size) - size), np.flatnonzero(size)
            sums = [np.zeros(len(part), np.uint64) for _ in range(2)]
            if len(some):
                sums[0][some] = np.add.reduceat(m, begins[some])
                sums[1][some] = np.add.reduceat(_mix(m + _U(0x632BE59BD9B4E019)), begins[some])
            signature = _signatures(text, key, len(part))
            width = _SKETCH_BITS << np.maximum(0, np.ceil(np.log2(2 * np.maximum(size, 1) / _SKETCH_BITS))).astype(np.int64)
            ends = np.cumsum(width)
            bit = (ends - width)[text] + ((m >> _U(20)).astype(np.int64) & (width[text] - 1))
            sketch = np.packbits((np.bincount(bit, minlength=int(ends[-1])) & 1).astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(size, pa.int64()),
                    *[pa.array(x.view(np.int64)) for x in sums],
                    pa.array([x.tobytes() for x in signature], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends // 64]), pa.int32()), pa.array(sketch)),
                ],
                names=["id", "n", "d1", "d2", "signature", "sketch"],
            )

    return body.mapInArrow(run, "id long, n long, d1 long, d2 long, signature binary, sketch array<long>")


def error_keys(signatures: np.ndarray, chunks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, chunk of each column): for each chunk and each symbol that may be wrong in it, a hash of the others.

    A key is below 2 ** 63, and its last bits tell which symbol may be wrong, twice.
    """
    columns, of = [], []
    for c, (begin, end) in enumerate(chunks):
        for wrong in range(begin, end):
            h = np.full(len(signatures), wrong + 1, np.uint64)
            for k in range(begin, end):
                if k != wrong:
                    h = _mix(h * _U(0xD6E8FEB86659FD93) + signatures[:, k].astype(np.uint64))
            columns.append(_tagged(h, wrong, wrong))
            of.append(c)
    return np.stack(columns, 1), np.array(of)


def _tagged(h: np.ndarray, wrong: int | np.ndarray, other: int | np.ndarray) -> np.ndarray:
    tag = (np.asarray(wrong) * SYMBOLS + other).astype(np.uint64)
    return (h >> _U(1)) & ~_U(SYMBOLS * SYMBOLS - 1) | tag


def _first_common(unlike: np.ndarray, chunks: list[tuple[int, int]], without: np.ndarray | None = None) -> np.ndarray:
    """Of each pair (a row of which symbols differ) the first symbol whose key both have; none of the chunk that has the symbol ``without``."""
    chunk_of = np.repeat(np.arange(len(chunks)), [end - begin for begin, end in chunks])
    begins = np.array([begin for begin, _ in chunks])
    few = np.add.reduceat(unlike, begins, axis=1, dtype=np.int64) <= 1
    if without is not None:
        few[np.arange(len(few)), chunk_of[without]] = False
    first = few.argmax(1)
    here = unlike & (chunk_of[None, :] == first[:, None])
    return np.where(few.any(1), np.where(here.any(1), here.argmax(1), begins[first]), -1)


def meetings(rows: DataFrame, most: int, chunks: list[tuple[int, int]], num: int, den: int) -> DataFrame:
    """(a, d1_a, b, d1_b, apart) of the rows (h, key, n, id, d1, component, signature, sketch) under one h, which are few, that

    are of different components, whose signatures differ in ``most`` symbols at most and
    whose sizes and sketches may reach the threshold. A pair that meets under several
    keys comes from the first only.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h, key, n, ids, d1, comp = (rows.column(c).to_numpy() for c in ("h", "key", "n", "id", "d1", "component"))
        own, other = key // SYMBOLS % SYMBOLS, key % SYMBOLS
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        sketch = rows.column("sketch").combine_chunks()
        words, width = sketch.flatten().to_numpy().view(np.uint64), sketch.value_lengths().to_numpy()
        at = np.cumsum(width) - width
        i, far = np.arange(len(h)), 0
        while len(i):  # rows under one h that are so many places apart
            far += 1
            i = i[i + far < len(h)]
            i = i[h[i] == h[i + far]]
            ok = (comp[i] != comp[i + far]) & (n[i] * den >= n[i + far] * num)  # rows under one h are in the order of size
            a = i[ok]
            for k in range(0, len(a), 50_000):
                x, y = a[k : k + 50_000], a[k : k + 50_000] + far
                unlike = signature[x] != signature[y]
                near = np.count_nonzero(unlike, axis=1) <= most
                x, y, unlike = x[near], y[near], unlike[near]
                first = _first_common(unlike, chunks)
                here = first == own[x]
                paired = own[x] != other[x]
                here[paired] &= _first_common(unlike[paired], chunks, first[paired]) == other[x][paired]
                x, y = x[here], y[here]
                bits = _unlike(words, at, width, x, y)
                may = bits * (den + num) <= (n[x] + n[y]) * (den - num)
                if may.any():
                    yield _pair(ids, d1, x[may], y[may], bits[may])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by h: all but the last h of a batch are complete
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            cut_at = int(np.searchsorted(h, h[-1], "left"))
            if cut_at or (held and held[-1].column(0)[-1].as_py() != h[0]):
                whole = pa.Table.from_batches([*held, batch.slice(0, cut_at)])
                held = []
                yield from pairs(whole)
            held.append(batch.slice(cut_at))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    ordered = rows.select("h", "key", "n", "id", "d1", "component", "signature", "sketch").repartition("h").sortWithinPartitions("h", "n", "id")
    return ordered.mapInArrow(run, "a long, d1_a long, b long, d1_b long, apart long")


def postings(signed: DataFrame, chunks: list[tuple[int, int]]) -> DataFrame:
    """(h, n, id, d1) for each key of each of ``signed``'s signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                rows = batch.slice(k, 2000)
                signatures = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys, _ = error_keys(signatures, chunks)
                others = [pa.array(np.repeat(rows.column(c).to_numpy(), keys.shape[1])) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *others], names=["h", "n", "id", "d1"])

    return signed.select("n", "id", "d1", "signature").mapInArrow(run, "h long, n long, id long, d1 long")


def paired_postings(met: DataFrame, chunks: list[tuple[int, int]]) -> DataFrame:
    """``met`` (h, id, d1, component, signature), each row under its key together with each key of another chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                rows = batch.slice(k, 2000)
                signatures = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys, of = error_keys(signatures, chunks)
                h = rows.column(0).to_numpy().view(np.uint64)
                own = of[np.argmax(keys == h[:, None], axis=1)]
                other = of[None, :] != own[:, None]
                row, column = np.nonzero(other)
                wrong = (h // _U(SYMBOLS) % _U(SYMBOLS)).astype(np.int64)
                both = _tagged(_mix(h[row] * _U(0x9E3779B97F4A7C15) ^ keys[row, column]), wrong[row], column)
                yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), *[rows.column(c).take(pa.array(row)) for c in (1, 2, 3)]], names=["h", "id", "d1", "component"])

    return met.select("h", "id", "d1", "component", "signature").mapInArrow(run, "h long, id long, d1 long, component long")


def _marked_hot(rows: DataFrame) -> DataFrame:
    """``rows`` with h below zero where its key's counter is far above the mean: the key may have very many rows."""
    counter = F.pmod(F.shiftright("h", 12), F.lit(COUNTERS))
    counted = cut(rows.groupBy(counter.alias("_c")).agg(F.count(F.lit(1)).alias("m")))
    total = counted.agg(F.sum("m")).first()[0] or 0
    hot = [r["_c"] for r in counted.where(F.col("m") > 2 * total / COUNTERS + POSTING_ROWS).select("_c").collect()]  # COUNTERS at most
    if not hot:
        return rows
    return rows.withColumn("h", F.when(F.array_contains(F.lit(hot), counter), -F.col("h") - 1).otherwise(F.col("h")))


def _symbols_apart(a: str, b: str) -> Column:
    """Symbols in which two signatures differ."""
    differs = lambda k: (F.substring(a, 2 * k + 1, 2) != F.substring(b, 2 * k + 1, 2)).cast("int")
    total = differs(0)
    for k in range(1, SYMBOLS):
        total = total + differs(k)
    return total


def near_pairs(pairs: DataFrame, signed: DataFrame, most: int, num: int, den: int) -> DataFrame:
    """(a, d1_a, b, d1_b, n_a, n_b, apart) of the ``pairs`` whose signatures differ in ``most`` symbols at most and whose sketches may reach the threshold."""
    left, right = (signed.select(*[F.col(c).alias(f"{c}_{x}" if c != "id" else x) for c in ("id", "d1", "n", "signature", "sketch")]) for x in "ab")
    both = pairs.select(*_KEYS).join(left, ["a", "d1_a"]).join(right, ["b", "d1_b"])
    both = both.where(_symbols_apart("signature_a", "signature_b") <= most).withColumn("apart", _differ())
    return both.where(_possible(num, den)).select(*_KEYS, "n_a", "n_b", "apart")


def minhash_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_ngrams, class_id, component_id) for each row of ``docs``.

    Documents link when den * |intersection| >= num * |union|. class_id is the
    smallest id with an equal set, component_id the smallest id reachable by links.
    """
    most = threshold(num, den)
    chunks = chunks_for(most)
    body = _body(docs, id_col, text)
    sets = cut(signed_sets(body, n))
    some = sets.where("n > 0 and id is not null")
    classes = cut(some.groupBy("n", "d1", "d2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("m")))
    # an id with several sets is one vertex: its classes are linked with it
    digests = F.struct("n", "d1", "d2")
    several = cut(sets.where("id is not null").groupBy("id").agg(F.min(digests).alias("low"), F.max(digests).alias("high")).where("low <> high").select("id"))
    ties = some.join(several, "id", "left_semi").select("id", "n", "d1", "d2").distinct().join(classes.drop("m"), ["n", "d1", "d2"])
    ties = cut_to_size(ties.where("id <> class_id").select(F.col("id").alias("u"), F.col("class_id").alias("v")), PAIRS_A_TASK)
    signed = some.select("id", "d1", "n", "signature", "sketch").dropDuplicates(["id", "d1"])
    signed = cut(signed.join(classes.select(F.col("class_id").alias("id"), "d1"), ["id", "d1"], "left_semi"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a common key may have a third of all sets: its posting is read in parts, whose smallest sets meet
    part = F.when(F.col("h") < 0, F.pmod(F.xxhash64("id", "d1"), F.lit(parts))).otherwise(0).cast("int")
    keyed = _marked_hot(postings(signed, chunks))
    live = cut(_live_postings(keyed.select("h", part.alias("part"), "n", "id", "d1"), num, den))
    heads = live.where("h < 0 and rank = 0").select("h", "id", "d1")
    lowest = heads.groupBy("h").agg(F.min(F.struct("id", "d1")).alias("least"))
    met = heads.join(lowest, "h").select(F.col("id").alias("a"), F.col("d1").alias("d1_a"), F.col("least.id").alias("b"), F.col("least.d1").alias("d1_b"))
    side = lambda x: live.select(F.col("id").alias("a"), F.col("d1").alias("d1_a"), F.col(x).alias("b"), F.col(f"{x}_d1").alias("d1_b"))
    stars = side("low").unionByName(side("last")).unionByName(met).where("a <> b or d1_a <> d1_b").distinct()
    first = cut_to_size(near_pairs(stars, signed, most, num, den), PAIRS_A_TASK)
    edges, found = _joined(first, ties, None, (None,), signed, body, n, _PLAIN, num, den)
    apart = _apart(live.select("h", "run", "id", "d1"), found)
    folded = signed.select("id", "d1", "n", "signature", _folded("sketch").alias("sketch"))
    met = meetings(apart.where(F.col("m") <= POSTING_ROWS).join(folded, ["id", "d1"]), most, chunks, num, den)
    large = apart.where(F.col("m") > POSTING_ROWS)
    if large.head(1):
        # under two keys fewer meet; what is common even so meets block by block
        own_key = large.select(F.col("key").alias("h"), "id", "d1", "component").join(signed.select("id", "d1", "signature"), ["id", "d1"])
        twice = _mixed(paired_postings(own_key, chunks)).withColumn("key", F.col("h"))
        met = met.unionByName(meetings(twice.where(F.col("m") <= POSTING_ROWS).join(folded, ["id", "d1"]), most, chunks, num, den))
        common = twice.where(F.col("m") > POSTING_ROWS)
        if common.head(1):
            brought = folded.withColumn("n", F.col("n").cast("int")).join(_met_keys(common), ["id", "d1"])
            met = met.unionByName(_block_meetings(common.join(brought, ["id", "d1"]), num, den))
    met = cut_to_size(near_pairs(met.select(*_KEYS).distinct(), signed, most, num, den), PAIRS_A_TASK)
    _, every = _joined(met, edges, found, TRIES, signed, body, n, _PLAIN, num, den)
    of_class = classes.join(every.withColumnRenamed("node", "class_id"), "class_id", "left").select(digests.alias("set"), "m", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    # a row that finds nothing is the only one of its class, and not linked
    index = cut_to_size(of_class.where("m > 1 or class_id <> component_id"), PAIRS_A_TASK)
    rows = sets.select("id", "n", F.when(F.col("n") > 0, digests).alias("set"))
    placed = look_up(rows, index, "set", "m", rows.count())
    vertices = several.join(every.select(F.col("node").alias("id"), F.col("component").alias("of_id")), "id")
    out = placed.join(F.broadcast(vertices) if vertices.count() <= PAIRS_A_TASK else vertices, "id", "left")
    known = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_ngrams"),
        F.when(known, F.coalesce("class_id", "id")).alias("class_id"),
        F.when(known, F.coalesce("of_id", "component_id", "id")).alias("component_id"),
    )


def _apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(h, key, id, d1, component, m) of the runs of postings that have documents of different components; m: how many rows."""
    key = F.when(F.col("h") < 0, -F.col("h") - 1).otherwise(F.col("h"))
    placed = rows.select(F.xxhash64("h", "run").alias("h"), key.alias("key"), "id", "d1").join(found.withColumnRenamed("node", "id"), "id", "left")
    return _mixed(placed.select("h", "key", "id", "d1", F.coalesce("component", "id").alias("component")))


def _mixed(placed: DataFrame) -> DataFrame:
    """``placed`` with m, the number of rows under h, where their components differ."""
    mixed = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high").select("h", "m")
    return cut(placed.join(mixed, "h"))
