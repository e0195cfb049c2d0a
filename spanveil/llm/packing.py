"""Packing documents into sequences by the sum-of-squares rule.

Documents are tokenised where they lie, longer ones are cut into pieces of a
whole sequence (the first piece takes what is left over), and only lengths
travel on. Pieces are dealt to parts of bounded size by a hash; in a part they
are placed longest first, each into the open sequence (or a new one) that makes
the sum of squared counts of open sequences per residual gap smallest. Sequences
that are nearly full are done; the pieces of the others are dealt anew to as many
parts as they need and placed again, until one part is left. When that leaves more
than half of the pieces, sequences that no waiting piece fits are done as well, and
when it still does, all are: more levels would place the same lengths anew.

Defined cases: a null or empty text is the end token alone; a null id stays null;
repeated rows are packed each; a text of any length is tokenised whole; among
pieces of one length the order is by a hash of id, piece and the row's place; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.storage import cut

#: Pieces in a part, about.
PART_PIECES = 60_000
#: A sequence with a smaller gap counts as full.
FULL_GAP = 16
# Fixed value: how a byte-level pre-tokenizer cuts a text into words.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _same_merges(path: str):
    """The vocabulary of a tokenizers file as one of tiktoken, which is several times faster; None where they differ.

    They give the same ids where words are cut alike, nothing is normalised, and
    each merge makes a token with the next id, so that a lower id is an earlier merge.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    plain = model["type"] == "BPE" and not any(model.get(k) for k in options) and not spec.get("normalizer")
    if not plain or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        return None
    added = {x["content"]: x for x in spec.get("added_tokens", [])}
    if any(x[k] for x in added.values() for k in ("single_word", "lstrip", "rstrip")):
        return None
    byte_of = _byte_of()
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items() if token not in added}
    made = [model["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
    if made != list(range(256, 256 + len(made))) or len(ranks) != 256 + len(made):
        return None
    return tiktoken.Encoding("same", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={k: x["id"] for k, x in added.items()})


class TextEncoder:
    """Ids of texts as the tokenizers library gives them, as little-endian bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fast = _same_merges(path)

    def encode(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:  # its pattern matcher gives up on very long runs of white space
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


@lru_cache(maxsize=2)
def _encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut to ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in _slices(whole):
                rows: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "crc": [], "ids": []}
                for row, text in enumerate(batch.column(1)):
                    found = encoder.encode(text.as_py()) + end
                    n = len(found) // 4
                    first = (n - 1) % capacity + 1
                    for piece, start in enumerate([0, *range(first, n, capacity)]):
                        stop = first if piece == 0 else start + capacity
                        body = found[4 * start : 4 * stop]
                        for k, v in zip(rows, (row, piece, start, stop - start, zlib.crc32(body), body if with_ids else None), strict=True):
                            rows[k].append(v)
                columns = [batch.column(0).take(pa.array(rows["row"], pa.int64())), pa.array(rows["piece"], pa.int32())]
                columns += [pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc")]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(rows["ids"], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, in this order, and the gap that each sequence is left with.

    A move from gap g to g - s changes the sum of squares by 2 (n[g-s] - n[g]) + 2;
    a new sequence by 2 n[capacity - s] + 1. Full sequences (gap 0) don't count.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        here, to = count[s:capacity], count[: capacity - s]
        g = capacity
        if len(here):
            change = np.where(here > 0, 2 * (to - here) + 2, np.iinfo(np.int64).max)
            if here[0] > 0:
                change[0] = 1 - 2 * here[0]
            best = int(change.argmin())
            if change[best] <= 2 * count[capacity - s] + 1:
                g = s + best
        if g == capacity:
            b = len(gaps)
            gaps.append(capacity)
        else:
            b = open_at[g].pop()
            count[g] -= 1
        sequence[i], offset[i] = b, capacity - g
        gaps[b] = g - s
        if g > s:
            open_at[g - s].append(b)
            count[g - s] += 1
    return sequence, offset, np.array(gaps, np.int64)


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length", keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset; no length may exceed ``capacity``."""
    row = F.struct(*[F.col(c) for c in pieces.columns])
    deal = F.xxhash64(*keys, F.monotonically_increasing_id())  # rows without a key or with the same one are dealt out, too
    waiting = cut(pieces.select(row.alias("row"), F.col(length).cast("long").alias("length"), deal.alias("deal")))
    done, level, count = None, 0, waiting.count()
    while True:
        parts = max(1, -(-count // PART_PIECES))

        def run(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            found = list(batches)
            if not found:
                return
            rows = pa.Table.from_batches(found)
            sequence, offset, gaps = place(rows.column("length").to_numpy(), capacity)
            ids = sequence + (level << 56) + (TaskContext.get().partitionId() << 32)
            for name, values in (("sequence_id", ids), ("offset", offset), ("gap", gaps[sequence])):
                rows = rows.append_column(name, pa.array(values))
            yield from rows.to_batches(max_chunksize=10_000)

        dealt = waiting.repartition(parts, "deal").sortWithinPartitions(F.desc("length"), "deal")
        placed = dealt.mapInArrow(run, f"{_ddl(waiting)}, sequence_id long, offset long, gap long")
        left = 0
        if parts > 1:
            placed, bound = cut(placed), FULL_GAP
            left, least = placed.where(F.col("gap") >= bound).agg(F.count(F.lit(1)), F.min("length")).first()
            if 2 * left > count and least > bound:
                bound = least
                left = placed.where(F.col("gap") >= bound).count()
        if not left or 2 * left > count:
            final = placed if done is None else done.unionByName(placed)
            return final.select("row.*", "sequence_id", "offset")
        closed = placed.where(F.col("gap") < bound)
        done = closed if done is None else done.unionByName(closed)
        waiting = placed.where(F.col("gap") >= bound).select("row", "length", "deal")
        count, level = left, level + 1


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each document."""
    return pack(tokenize_pieces(docs, tokenizer_path, capacity, end_id, id_col, text), capacity, keys=(id_col, "piece"))
