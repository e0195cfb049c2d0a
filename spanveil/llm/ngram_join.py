"""Similarity self-join of documents by the Jaccard similarity of word n-grams.

N-grams have one global order: those that many documents share come last, and
otherwise the order is that of their hash. Two sets that reach the threshold must
share one of the first few n-grams of either; documents that do are candidates.
To decide on a candidate pair, the order is cut into fragments: the overlap is
counted in each fragment separately and summed for the pair.

Documents with equal sets are one class and take part once. Candidates are not
expanded into all pairs of a posting. A posting in the order of size falls into
runs that sizes keep apart. In its runs each document meets the smallest one and the
one before it; then only documents that are still in different components meet,
inside tasks (block by block, if a posting is large), where a parity sketch rules
out most pairs before any row is made. What is left is verified in rounds, each
document's likeliest pairs first; pairs that a round's links join need no more.

Which n-grams count as common only affects the work, never the result; so the
filter that holds them has a bounded size.

Defined cases: a null or empty text, or one without words, has no n-grams, and is
linked with nothing; with fewer than ``n`` words the whole sequence is the only
n-gram; a text of any length is read whole; rows with a null id have a set but no
component (null); rows that repeat an id are one vertex; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.components import components, cut_to_size
from spanveil.storage import cut

#: Texts are read in slices of so many rows, and parts of about so many bytes.
_SLICE, _PART_BYTES = 500, 500_000
#: N-grams are counted in two to the power of so many counters, a few for each document.
COUNTER_BITS = (18, 24)
#: An n-gram is common when its counter exceeds twice the mean counter by so much.
COMMON = 16
_CHUNK = 4096  # counters in a row
_BUCKET = 4096  # bytes of a bitmap that bitmap_construct_agg makes
#: Postings of more documents are cut into blocks of about so many.
POSTING_ROWS = 2048
#: A sketch has two to four bits for each n-gram, and so many at least.
SKETCH_BITS = 256
#: A document brings so many of its postings along to tell where a pair of documents met before.
MET_KEYS = 32
#: Documents are picked for verification by a filter of so many bits, then exactly.
PICK_BITS = 1 << 23
#: The order is cut at its leading bits.
FRAGMENT_BITS = 4
#: A task takes so many pairs.
PAIRS_A_TASK = 20_000
#: Pairs of a document that are verified in a round; in the last one all that are left.
TRIES = (2, 16, None)
_TOP = np.uint64(1 << 63)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class NgramHasher:
    """Distinct n-grams of many texts at once, as 63-bit hashes."""

    def __init__(self, n: int):
        self.n = n
        self.letters = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        self.letters[65:91] = self.letters[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.power) < size:
            base = 0x9E3779B97F4A7C15 | 1

            def powers(b: int) -> np.ndarray:
                factors = np.full(size, b, np.uint64)
                factors[0] = 1
                return np.cumprod(factors, dtype=np.uint64)

            self.power, self.inverse = powers(base), powers(pow(base, -1, 1 << 64))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of all n-grams of each text, with repeats."""
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if not len(data):
            return none
        self._powers(len(data) + 1)
        blank = self.space[data]
        edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            return none
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.power[: len(data)])])
        words = _mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        lengths = np.array([len(x) + 1 for x in texts])
        of = np.searchsorted(np.cumsum(lengths), starts, "right")
        count = np.bincount(of, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        sizes = np.minimum(count, self.n)
        at = np.repeat(first, np.maximum(count - self.n + 1, (count > 0).astype(np.int64)))
        text = np.repeat(np.arange(len(texts)), np.maximum(count - self.n + 1, (count > 0).astype(np.int64)))
        at = at + np.arange(len(at)) - np.searchsorted(text, text, "left")
        h = sizes[text].astype(np.uint64)
        for k in range(self.n):
            inside = k < sizes[text]
            h = np.where(inside, _mix(h * _U(0xD6E8FEB86659FD93) + words[np.minimum(at + k, len(words) - 1)]), h)
        return text, h >> _U(1)


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in small parts, with the texts in ``column`` as bytes."""
    for batch in batches:
        for k in range(0, batch.num_rows, _SLICE):
            rows = batch.slice(k, _SLICE)
            part, begin, size = [], 0, 0
            for i, x in enumerate(rows.column(column).cast(pa.large_binary()).to_pylist()):
                part.append(x)
                size += len(x)
                if size >= _PART_BYTES:
                    yield rows.slice(begin, len(part)), part
                    part, begin, size = [], i + 1, 0
            if part:
                yield rows.slice(begin, len(part)), part


def _distinct(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[new], key[new]


def _body(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _bitmap(positions: DataFrame, bits: int) -> bytes:
    """The bits at the ``position`` (from 0) of each row, put together by aggregation."""
    at = F.col("position") + 1
    parts = positions.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    filled = {r.part: bytes(r.bits) for r in parts.collect()}
    return b"".join(filled.get(k + 1, bytes(_BUCKET)) for k in range(bits // 8 // _BUCKET))


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Is the bit at each place set? (Bits stay packed: eight times less memory.)"""
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def common_ngrams(body: DataFrame, n: int, num: int = 80, den: int = 100) -> tuple[bytes, bytes]:
    """Two filters (bits by the low bits of the hash) of n-grams that many documents have.

    Every n-gram of every document is counted. Those whose hashes are small enough to
    lead sets, which are few, are counted once more in counters of their own, which
    tell even moderately common ones. Counters are shared by n-grams with equal low
    bits, so a common n-gram can't be missed, and what a task passes on is bounded by
    the number of counters.
    """
    rows = int(body.count()).bit_length()
    bits = [min(max(COUNTER_BITS[0], rows + more), COUNTER_BITS[1]) for more in (2, 4)]
    small, chunks = _lead_bound(num, den), [(1 << b) // _CHUNK for b in bits]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = NgramHasher(n), [np.zeros(1 << b, np.uint32) for b in bits]
        for _, part in _parts(batches, 0):
            h = _distinct(*hasher(part))[1]
            for held, of in zip(counts, (h, h[h < small]), strict=True):
                np.add.at(held, (of & _U(len(held) - 1)).astype(np.int64), 1)
        for first, held in zip((0, chunks[0]), counts, strict=True):
            held = held.reshape(-1, _CHUNK)
            some = np.flatnonzero(held.any(1))
            for k in range(0, len(some), 64):  # as bytes where they fit
                found = [(x.astype(np.uint8) if x.max() < 256 else x).tobytes() for x in held[some[k : k + 64]]]
                yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 64] + first, pa.int32()), pa.array(found, pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(_CHUNK, np.int64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([int(total.sum())]), pa.array([total.tobytes()])], names=["chunk", "total", "counts"])
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk != now:
                    if now is not None:
                        yield row()
                    now, total[:] = chunk, 0
                data = counts.as_buffer()
                total += np.frombuffer(data, np.uint8 if data.size == _CHUNK else np.uint32)
        if now is not None:
            yield row()

    parts = body.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    summed = cut(parts.mapInArrow(add, "chunk int, total long, counts binary"))
    second = F.col("chunk") >= chunks[0]
    totals = summed.agg(F.sum(F.when(~second, F.col("total"))), F.sum(F.when(second, F.col("total")))).first()
    bounds = [2 * (total or 0) / (1 << b) + COMMON for total, b in zip(totals, bits, strict=True)]

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = [np.frombuffer(x.as_buffer(), np.int64) > bounds[chunk >= chunks[0]] for chunk, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            flags = [np.packbits(x, bitorder="little").tobytes() for x in over]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.binary())], names=["chunk", "flags"])

    flags = {r.chunk: bytes(r.flags) for r in summed.select("chunk", "counts").mapInArrow(flag, "chunk int, flags binary").collect()}
    whole = b"".join(flags.get(k, bytes(_CHUNK // 8)) for k in range(sum(chunks)))
    return whole[: (1 << bits[0]) // 8], whole[(1 << bits[0]) // 8 :]


def _lead_bound(num: int, den: int) -> np.uint64:
    """Hashes below lead sets, where few n-grams are common."""
    return _U(int(min(1.0, 1.3 * (den - num) / den) * ((1 << 63) - 1)))


def _take(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """So many n-grams of a set lead it."""
    return np.where(size > 0, size - -(-num * size // den) + 1, 0)


class _Ordered:
    """Distinct n-grams of texts as keys of the global order."""

    def __init__(self, n: int, common: tuple[bytes, bytes], num: int, den: int):
        self.hasher, self.small = NgramHasher(n), _lead_bound(num, den)
        self.filters = [np.frombuffer(x, np.uint8) for x in common]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text, h = self.hasher(texts)
        every, small = (_has(x, (h & _U(8 * len(x) - 1)).astype(np.int64)) for x in self.filters)
        return _distinct(text, np.where(every | (small & (h < self.small)), h | _TOP, h))


def ngram_sets(body: DataFrame, n: int, common: tuple[bytes, bytes], num: int, den: int) -> DataFrame:
    """(id, n, d1, d2, prefix, sketch): each set's size, digests, first n-grams and parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = _Ordered(n, common, num, den)
        for rows, part in _parts(batches, 1):
            text, key = ordered(part)
            size = np.bincount(text, minlength=len(part))
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            m = _mix(key)
            sums = [np.zeros(len(part), np.uint64) for _ in range(2)]
            some = np.flatnonzero(size)
            if len(some):
                sums[0][some] = np.add.reduceat(m, first[some])
                sums[1][some] = np.add.reduceat(_mix(m + _U(0x632BE59BD9B4E019)), first[some])
            take = _take(size, num, den)
            chosen = np.arange(len(key)) - first[text] < take[text]
            width = SKETCH_BITS << np.maximum(0, np.ceil(np.log2(2 * np.maximum(size, 1) / SKETCH_BITS))).astype(np.int64)
            ends = np.cumsum(width)
            bit = (ends - width)[text] + ((m >> _U(20)).astype(np.int64) & (width[text] - 1))
            parity = (np.bincount(bit, minlength=int(ends[-1])) & 1).astype(np.uint8)
            sketch = np.packbits(parity).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(size, pa.int64()),
                    *[pa.array(x.view(np.int64)) for x in sums],
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(key[chosen].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends // 64]), pa.int32()), pa.array(sketch)),
                ],
                names=["id", "n", "d1", "d2", "prefix", "sketch"],
            )

    return body.mapInArrow(run, "id long, n long, d1 long, d2 long, prefix array<long>, sketch array<long>")


def ngram_fragments(body: DataFrame, n: int, common: tuple[bytes, bytes], num: int, den: int, picks: bytes) -> DataFrame:
    """(id, d1, fragment, ngrams): the sets that ``picks`` holds, each once, cut at fixed places of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = _Ordered(n, common, num, den)
        picked = np.frombuffer(picks, np.uint8)

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column(0).is_valid())
                yield batch.filter(pa.array(_has(picked, batch.column(0).to_numpy() % PICK_BITS)))

        for rows, part in _parts(chosen(), 1):
            text, key = ordered(part)
            if not len(text):
                continue
            cell = (text << FRAGMENT_BITS) | (key >> _U(64 - FRAGMENT_BITS)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            digest = np.repeat(np.add.reduceat(_mix(key), begins), np.diff(np.append(begins, len(text))))[at]
            ids = rows.column(0).take(pa.array(text[at]))
            fragment = pa.array(cell[at] & ((1 << FRAGMENT_BITS) - 1), pa.int32())
            grams = pa.ListArray.from_arrays(pa.array(np.append(at, len(key)), pa.int32()), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(digest.view(np.int64)), fragment, grams], names=["id", "d1", "fragment", "ngrams"])

    return body.mapInArrow(run, "id long, d1 long, fragment int, ngrams array<long>").dropDuplicates(["id", "d1", "fragment"])


def _differ():
    """Bits in which the sketches of a and b differ: a sketch that is twice as wide is folded; other widths tell nothing."""
    a, b = F.col("sketch_a"), F.col("sketch_b")
    bits = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(a) == F.size(b), bits(a, b)).when(F.size(a) == 2 * F.size(b), bits(folded(a), b)).when(F.size(b) == 2 * F.size(a), bits(a, folded(b))).otherwise(0)


def _possible(num: int, den: int):
    """Sets a and b that the sizes and ``apart``, how far the parity sketches differ, don't rule out.

    A sketch bit is the parity of the n-grams on it, so two sketches differ in no
    more bits than the sets differ in n-grams; and sets that reach the threshold
    differ in (den - num) / (den + num) of their summed sizes at most.
    """
    sizes = (F.least("n_a", "n_b") * den) >= (F.greatest("n_a", "n_b") * num)
    return sizes & (F.col("apart") * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num))


def _folded(sketch: str):
    """A sketch of a quarter of the width, and of SKETCH_BITS at least, to meet with."""
    half = lambda x: (F.size(x) / 2).cast("int")
    fold = lambda x: F.when(F.size(x) * 64 <= SKETCH_BITS, x).otherwise(F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q)))
    return fold(fold(F.col(sketch)))


_KEYS = ["a", "d1_a", "b", "d1_b"]


def _candidates(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(a, d1_a, b, d1_b, n_a, n_b, apart) of the ``pairs`` that may reach the threshold."""
    left, right = (sketches.select(*[F.col(c).alias(f"{c}_{x}" if c != "id" else x) for c in sketches.columns]) for x in "ab")
    both = pairs.join(left, ["a", "d1_a"]).join(right, ["b", "d1_b"]).withColumn("apart", _differ())
    return both.where(_possible(num, den)).select(*_KEYS, "n_a", "n_b", "apart")


def verified(pairs: DataFrame, body: DataFrame, n: int, common: tuple[bytes, bytes], num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a, d1_a, b, d1_b, n_a, n_b) that reach the threshold, from overlaps summed over fragments."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    fragments = ngram_fragments(body, n, common, num, den, _bitmap(needed.select(F.pmod("id", F.lit(PICK_BITS)).alias("position")), PICK_BITS))
    cut_pairs = pairs.select(*_KEYS, "n_a", "n_b", F.explode(F.sequence(F.lit(0), F.lit((1 << FRAGMENT_BITS) - 1))).alias("fragment"))
    of_a, of_b = (fragments.select(F.col("id").alias(x), F.col("d1").alias(f"d1_{x}"), "fragment", F.col("ngrams").alias(f"grams_{x}")) for x in "ab")
    met = cut_pairs.join(of_a, ["a", "d1_a", "fragment"]).join(of_b, ["b", "d1_b", "fragment"])
    partial = met.select(*_KEYS, "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    overlap = partial.groupBy(*_KEYS, "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    return overlap.where((F.col("overlap") * den) >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * num).select("a", "b").distinct()


def _joined(met: DataFrame, links: DataFrame, every: DataFrame | None, rounds: tuple, sketches: DataFrame, body: DataFrame, n: int, common: tuple[bytes, bytes], num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``links`` (u, v) with links of the pairs ``met`` (a, d1_a, b, d1_b, apart), and the components of both.

    In a round the likeliest pairs of each document are verified; what their links
    join needn't be compared any more. ``every``: the components of ``links``, if known.
    """
    for tries in rounds:
        if met.isEmpty():
            break
        some = met
        if tries:
            best = [met.withColumn("_r", F.row_number().over(Window.partitionBy(x, f"d1_{x}").orderBy("apart", *_KEYS))).where(F.col("_r") <= tries).drop("_r") for x in "ab"]
            some = cut_to_size(reduce(DataFrame.unionByName, best).distinct(), PAIRS_A_TASK)
        chosen = some if "n_a" in some.columns else cut_to_size(_candidates(some.select(*_KEYS), sketches, num, den), PAIRS_A_TASK)
        links = cut_to_size(links.unionByName(verified(chosen, body, n, common, num, den).select(F.col("a").alias("u"), F.col("b").alias("v"))), PAIRS_A_TASK)
        every = cut(components(links))
        if not tries:
            break
        left = met.join(some.select(*_KEYS), _KEYS, "left_anti")
        for x in "ab":
            left = left.join(every.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")), x, "left")
        met = cut_to_size(left.where("coalesce(of_a, a) <> coalesce(of_b, b)").select(*met.columns), PAIRS_A_TASK)
    return links, cut(components(links)) if every is None else every


def _unlike(words: np.ndarray, at: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of i and j differ; the sketch of j is as wide or folded once."""
    out = np.zeros(len(i), np.int64)
    for w in np.unique(width[i]).tolist():
        for times in (1, 2):
            all_of = np.flatnonzero((width[i] == w) & (width[j] == w * times))
            for k in range(0, len(all_of), step := max(1, 4_000_000 // w)):
                some, column = all_of[k : k + step], np.arange(w)
                x = words[at[i[some], None] + column] ^ words[at[j[some], None] + column]
                if times == 2:
                    x ^= words[at[j[some], None] + w + column]
                out[some] = np.bitwise_count(x).sum(1, dtype=np.int64)
    return out


def _met_before(keys: pa.ListArray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Do documents a and b share a posting below ``h`` among those that they bring along (in order)?

    They meet there in the same way as here, so that a pair is made at the least posting
    that both bring along, and at those beyond only if they bring none.
    """
    flat, width = keys.flatten().to_numpy(), keys.value_lengths().to_numpy()
    at, out = np.cumsum(width) - width, np.zeros(len(a), bool)
    column = np.arange(MET_KEYS)
    for k in range(0, len(a), 2000):
        i, j, bound = (x[k : k + 2000, None] for x in (a, b, h))
        held = [np.where(column < width[x], flat[np.minimum(at[x] + column, max(0, len(flat) - 1))], bound) for x in (i, j)]
        some = (held[0][:, :, None] == held[1][:, None, :]) & (held[0] < bound)[:, :, None]
        out[k : k + 2000] = some.any((1, 2))
    return out


def _met_keys(rows: DataFrame) -> DataFrame:
    """(id, d1, keys): of the rows (h, id, d1) of postings the first that each document brings along."""
    return rows.groupBy("id", "d1").agg(F.slice(F.array_sort(F.collect_set("h")), 1, MET_KEYS).alias("keys"))


_PAIR = "a long, d1_a long, b long, d1_b long, apart long"


def _pair(ids: np.ndarray, d1: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], d1[a], ids[b], d1[b], apart)], names=["a", "d1_a", "b", "d1_b", "apart"])


def _meetings(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(a, d1_a, b, d1_b) of documents of one small posting that are in different components and may reach the threshold.

    A pair that met in an earlier posting isn't made again.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h, ids, d1, n, comp = (rows.column(c).to_numpy() for c in ("h", "id", "d1", "n", "component"))
        sketch = rows.column("sketch").combine_chunks()
        words, width = sketch.flatten().to_numpy().view(np.uint64), sketch.value_lengths().to_numpy()
        at, keys = np.cumsum(width) - width, rows.column("keys").combine_chunks()
        i, far = np.arange(len(h)), 0
        while len(i):  # rows of a posting that are so many places apart
            far += 1
            i = i[i + far < len(h)]
            i = i[h[i] == h[i + far]]
            j = i + far  # a posting is in the order of size
            ok = (comp[i] != comp[j]) & (n[i] * den >= n[j] * num)
            a, b = i[ok], j[ok]
            unlike = _unlike(words, at, width, a, b)
            ok = unlike * (den + num) <= (n[a] + n[b]) * (den - num)
            a, b, unlike = a[ok], b[ok], unlike[ok]
            if len(a) and not (again := _met_before(keys, h[a], a, b)).all():
                yield _pair(ids, d1, a[~again], b[~again], unlike[~again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by h: all but the last posting of a batch are complete
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            cut_at = int(np.searchsorted(h, h[-1], "left"))
            if cut_at:
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
                held = []
            elif held and held[-1].column(0)[-1].as_py() != h[0]:
                yield from pairs(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return postings.select("h", "id", "d1", "n", "component", "sketch", "keys").repartition("h").sortWithinPartitions("h", "n", "id").mapInArrow(run, _PAIR)


def _block_meetings(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(a, d1_a, b, d1_b) as of _meetings from large postings, none of which is one task.

    A posting is cut into classes of size, of which only equal and neighbouring
    ones hold sets that may reach the threshold, and these into blocks; pairs of
    blocks meet in an equi join, each in a row of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same, posting = batch.column(0)[row].as_py(), batch.column(3)[row].as_py()
                sides = [batch.column(c).slice(row, 1).flatten() for c in (1, 2)]
                both, first = pa.concat_arrays(sides), len(sides[0])
                ids, d1, n, comp = (both.field(c).to_numpy() for c in range(4))
                sketch = both.field(4)
                words, width = sketch.flatten().to_numpy().view(np.uint64), sketch.value_lengths().to_numpy()
                at, keys = np.cumsum(width) - width, both.field(5)
                for k in range(0, first, 64):
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(k, min(k + 64, first)), np.arange(first, len(n)), indexing="ij"))
                    low = n[i] <= n[j]
                    ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
                    if same:
                        ok &= j - first > i
                    a, b = np.where(low, i, j)[ok], np.where(low, j, i)[ok]
                    unlike = _unlike(words, at, width, a, b)
                    ok = unlike * (den + num) <= (n[a] + n[b]) * (den - num)
                    a, b, unlike = a[ok], b[ok], unlike[ok]
                    if len(a) and not (again := _met_before(keys, np.full(len(a), posting), a, b)).all():
                        yield _pair(ids, d1, a[~again], b[~again], unlike[~again])

    step = 1.001 * max(math.log(den / num), 0.01)
    rows = cut(postings.select("h", "id", "d1", "n", "component", "sketch", "keys", F.floor(F.log("n") / step).alias("size")))
    slots = cut(rows.groupBy("h", "size").agg(F.ceil(F.count(F.lit(1)) / POSTING_ROWS).alias("slots")))
    placed = rows.join(slots, ["h", "size"]).withColumn("slot", F.pmod(F.xxhash64("id", "d1"), F.col("slots")))
    blocks = cut(placed.groupBy("h", "size", "slot").agg(F.collect_list(F.struct("id", "d1", "n", "component", "sketch", "keys")).alias("found")))
    of_a, of_b = (slots.select("h", F.col("size").alias(f"size_{x}"), F.col("slots").alias(f"slots_{x}")) for x in "ab")
    near = of_a.select("*", F.explode(F.array("size_a", F.col("size_a") + 1)).alias("size_b")).join(of_b, ["h", "size_b"])
    for x in "ab":
        near = near.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"slots_{x}") - 1)).alias(f"slot_{x}"))
    tiles = near.where("size_a < size_b or slot_a <= slot_b")
    for x in "ab":
        side = blocks.select("h", F.col("size").alias(f"size_{x}"), F.col("slot").alias(f"slot_{x}"), F.col("found").alias(f"found_{x}"))
        tiles = tiles.join(side, ["h", f"size_{x}", f"slot_{x}"])
    return tiles.select(F.expr("size_a = size_b and slot_a = slot_b"), "found_a", "found_b", "h").mapInArrow(run, _PAIR)


def _live_postings(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(h, run, id, d1, low, low_d1, last, last_d1, rank) of the postings (h, part, n, id, d1) in which sets may be alike.

    A posting's part is read in the order of size and ends a run where the next set is
    too large for the one before; sets of different runs can't reach the threshold.
    ``low`` is the first of the run (the row itself, if their sizes rule it out), ``last``
    the one before the row, ``rank`` the row's place. Rows are read once, and none is
    held but the last. Runs of one row are left out, but for common n-grams (below
    zero), whose parts have rows elsewhere; these have no ``run``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "run", "id", "d1", "low", "low_d1", "last", "last_d1", "rank"]
        held: list[np.ndarray] = []  # the last row: h, part, n, id, d1, then first (n, id, d1), rank, last, last_d1
        for batch in batches:
            if not batch.num_rows:
                continue
            h, part, n, ids, d1 = (batch.column(i).to_numpy() for i in range(5))
            if held:
                h, part, n, ids, d1 = (np.concatenate([x, y]) for x, y in zip(held, (h, part, n, ids, d1), strict=False))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (n[:-1] * den < n[1:] * num)
            at = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            first, rank = [x[at][of] for x in (n, ids, d1)], np.arange(len(h)) - at[of]
            last, last_d1 = (np.where(new, x, np.roll(x, 1)) for x in (ids, d1))
            if held:
                same = of == 0
                for x, y in zip(first, held[5:8], strict=True):
                    x[same] = y[0]
                rank[same] += held[8][0]
                last[0], last_d1[0] = held[9][0], held[10][0]
            multi = (np.bincount(of)[of] > 1) | (rank > 0) | (h < 0)
            multi[-1] = False  # the next batch tells
            alike = first[0] * den >= n * num
            columns = (h, np.where(h < 0, 0, first[0]), ids, d1, np.where(alike, first[1], ids), np.where(alike, first[2], d1), last, last_d1, rank)
            yield pa.RecordBatch.from_arrays([pa.array(x[multi]) for x in columns], names=names)
            held = [x[-1:] for x in (h, part, n, ids, d1, *first, rank, last, last_d1)]
            end = [x[-1:] for x in columns]
        if held and (held[8][0] > 0 or held[0][0] < 0):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in end], names=names)

    ordered = postings.repartition("h", "part").sortWithinPartitions("h", "part", "n", "id", "d1")
    return ordered.mapInArrow(run, "h long, run long, id long, d1 long, low long, low_d1 long, last long, last_d1 long, rank long")


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_ngrams, class_id, component_id) for each row of ``docs``.

    Documents link when den * |intersection| >= num * |union|. class_id is the
    smallest id with an equal set, component_id the smallest id reachable by links.
    """
    body = _body(docs, id_col, text)
    common = common_ngrams(body, n, num, den)
    sets = cut(ngram_sets(body, n, common, num, den))
    some = sets.where("n > 0 and id is not null")
    classes = some.groupBy("n", "d1", "d2").agg(F.min("id").alias("class_id"))
    classes = cut(classes)
    # an id with several sets is one vertex: its classes are linked with it
    sets_of = sets.where("id is not null").groupBy("id").agg(F.min(F.struct("n", "d1", "d2")).alias("low"), F.max(F.struct("n", "d1", "d2")).alias("high"))
    several = cut(sets_of.where("low <> high").select("id"))
    ties = some.join(several, "id", "left_semi").select("id", "n", "d1", "d2").distinct().join(classes, ["n", "d1", "d2"])
    ties = cut_to_size(ties.where("id <> class_id").select(F.col("id").alias("u"), F.col("class_id").alias("v")), PAIRS_A_TASK)
    unique = some.select("id", "d1", "n", "prefix").dropDuplicates(["id", "d1"])
    chosen = unique.join(classes.select(F.col("class_id").alias("id"), "d1"), ["id", "d1"], "left_semi")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a common n-gram may lead a third of all sets: its posting is read in parts, whose smallest sets meet
    part = F.when(F.col("h") < 0, F.pmod(F.xxhash64("id", "d1"), F.lit(parts))).otherwise(0).cast("int")
    live = cut(_live_postings(chosen.select(F.explode("prefix").alias("h"), "n", "id", "d1").select("h", part.alias("part"), "n", "id", "d1"), num, den))
    heads = live.where("h < 0 and rank = 0").select("h", "id", "d1")
    lowest = heads.groupBy("h").agg(F.min(F.struct("id", "d1")).alias("least"))
    met = heads.join(lowest, "h").select(F.col("id").alias("a"), F.col("d1").alias("d1_a"), F.col("least.id").alias("b"), F.col("least.d1").alias("d1_b"))
    side = lambda x: live.select(F.col("id").alias("a"), F.col("d1").alias("d1_a"), F.col(x).alias("b"), F.col(f"{x}_d1").alias("d1_b"))
    stars = side("low").unionByName(side("last")).unionByName(met).where("a <> b or d1_a <> d1_b").distinct()
    sketches = cut(sets.where("n > 0 and id is not null").select("id", "d1", "n", "sketch").dropDuplicates(["id", "d1"]))
    edges, found = _joined(cut_to_size(_candidates(stars, sketches, num, den), PAIRS_A_TASK), ties, None, (None,), sketches, body, n, common, num, den)
    placed = live.select(F.xxhash64("h", "run").alias("h"), "id", "d1").join(found.withColumnRenamed("node", "id"), "id", "left").select("h", "id", "d1", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high").select("h", "m")
    apart = cut(placed.join(mixed, "h"))  # documents of different components in one posting
    folded = sketches.select("id", "d1", F.col("n").cast("int").alias("n"), _folded("sketch").alias("sketch"))
    folded = folded.join(_met_keys(apart), ["id", "d1"])
    meetings = _meetings(apart.where(F.col("m") <= POSTING_ROWS).join(folded, ["id", "d1"]), num, den)
    large = apart.where(F.col("m") > POSTING_ROWS)
    if not large.isEmpty():
        meetings = meetings.unionByName(_block_meetings(large.join(folded, ["id", "d1"]), num, den))
    met = cut_to_size(meetings.groupBy(*_KEYS).agg(F.min("apart").alias("apart")), PAIRS_A_TASK)
    _, every = _joined(met, edges, found, TRIES, sketches, body, n, common, num, den)
    own = classes.join(every.withColumnRenamed("node", "class_id"), "class_id", "left")
    own = own.select("n", "d1", "d2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    vertices = several.join(every.select(F.col("node").alias("id"), F.col("component").alias("of_id")), "id")
    out = sets.select("id", "n", "d1", "d2").join(own, ["n", "d1", "d2"], "left").join(vertices, "id", "left")
    alone = F.col("n") == 0
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_ngrams"),
        F.when(alone, F.col("id")).when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"),
        F.coalesce("of_id", F.when(alone, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id"))).alias("component_id"),
    )


def keep_representatives(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows with a null id stay.
    """
    found = ngram_components(docs, n, num, den, id_col, text)
    stay = found.where(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias("_stay")).distinct()
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    kept = whole.join(stay, whole["_id"] == stay["_stay"], "left_semi")
    return kept.unionByName(whole.where("_id is null")).select("_row.*")
