"""Packing of tokenized documents into training sequences: best-fit decreasing with a segment tree.

Documents longer than a window are first cut into full windows; what remains of each goes, longest
first, into the open window with the least room that still holds it. A segment tree over remaining
capacities finds that window in log2(window) steps, however many windows are open.

Packing is local to an input partition and, within it, to blocks of ``BLOCK_TOKENS`` tokens: nothing
is shuffled, a task holds one block at a time, and the windows left partly empty are a few of the
thousands in a block. A retried task reads the same split again and so makes the same sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import default_tokenizer, encoder, grouped, short_batches

WINDOW = 2048
BLOCK_TOKENS = 4_000_000
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """Open windows by remaining capacity; the tree holds, for each range of capacities, how many there are."""

    def __init__(self, window: int):
        self.window, self.leaves = window, 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, capacity: int, one: int) -> None:
        self.at[capacity].append(one)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest remaining capacity of at least ``least``, and that capacity."""
        k, count = least + self.leaves, self.count
        if not count[k]:
            while k & 1 or not count[k + 1]:  # up until a range to the right holds a window
                k >>= 1
                if k <= 1:
                    return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """(window of each piece, its offset there, number of windows); equal lengths keep their order."""
    of, offset, n, tree = [0] * len(lengths), [0] * len(lengths), 0, OpenWindows(window)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if (found := tree.take(lengths[k])) is None:
            found, n = (window, n), n + 1
        room, one = found
        of[k], offset[k] = one, window - room
        if room > lengths[k]:
            tree.put(room - lengths[k], one)
    return of, offset, n


def _packed(docs: Iterator[tuple[int | None, bytes]], window: int, first_id: int, block: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    tokens, next_id = 0, first_id

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, tokens, next_id
        of, offset, n = best_fit_decreasing([x[2] for x in held], window)
        for k in range(0, len(held), 2000):
            some = held[k : k + 2000]
            cols = [*zip(*some, strict=True)]
            seq = [next_id + x for x in of[k : k + 2000]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(seq, pa.int64()), pa.array(offset[k : k + 2000], pa.int64()), pa.array(cols[4], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        held, tokens, next_id = [], 0, next_id + n

    for doc_id, ids in docs:
        total = len(ids) // 4
        for start in range(0, total, window):
            end = min(start + window, total)
            held.append((doc_id, start, end - start, total, ids[4 * start : 4 * end]))
            tokens += end - start
            if tokens >= block:
                yield from flush()
    if held:
        yield from flush()


def pack(docs: DataFrame, *, window: int = WINDOW, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most ``window`` tokens.

    Columns: doc_id, start (of the piece in its document), length, doc_tokens, sequence_id, offset (of
    the piece in the sequence, gapless from 0), ids (little-endian uint32). Every token of a document,
    the end id with it, lies in exactly one piece; pieces of full length are sequences of their own.

    Nulls and empty texts: one piece with the end id alone; a null id stays. Repeated rows are packed
    each. An empty table gives no rows. Other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)

        def each() -> Iterator[tuple[int | None, bytes]]:
            for b in grouped(batches, 1):
                at, flat = enc.encode(b.column(1), end_id)
                raw = memoryview(flat.tobytes())
                yield from ((i, bytes(raw[x:y])) for i, (x, y) in zip(b.column(0).to_pylist(), pairwise((4 * at).tolist()), strict=True))

        yield from _packed(each(), window, TaskContext.get().partitionId() << 36, block_tokens)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def sequences(pieces: DataFrame, *, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, length): the sequences themselves, padded to ``window`` ids. At most a window meets in a group."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda acc, p: F.concat(acc, p))
    pad = np.array([pad_id] * window, "<u4").tobytes().hex()
    grown = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
    return grown.select("sequence_id", F.substring(F.concat("ids", F.unhex(F.lit(pad))), 1, 4 * window).alias("ids"), "length")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the whole documents table; digests of the ids replace the ids."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
