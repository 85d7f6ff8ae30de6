"""Token ids on disk: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank in the whole corpus (0: most frequent). A rank takes one to four
bytes; the lengths go, two bits each, four to a byte, into a separate control stream. A control byte
says at once where its four ranks lie, so numpy decodes whole blocks by table lookup.

File format (Parquet as the container, so any store that Spark reads will do and commits are Spark's):
``ids/``: one row for each document in ascending doc_id order within numbered parts that follow each
other: part, doc_id, start_in_part, n_tokens, control, data. ``parts/``: part, before (ids in all parts
before it). ``ranks/``: one row for each distinct id: rank, id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import discard, fresh_path, materialize
from .tokens import as_binary, default_tokenizer, encoder, grouped, short_batches

#: Bytes that the four codes of a control byte take; derived from its bits.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
TOTALS = LENGTHS.sum(axis=1)
OFFSETS = np.cumsum(LENGTHS, axis=1) - LENGTHS
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(rows: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """(control, data) of each row of uint32 ranks; a row's last four are filled up with rank 0."""
    quads = np.array([-(-len(x) // 4) for x in rows], np.int64)
    first = np.cumsum(quads) - quads
    ranks = np.zeros(4 * int(quads.sum()), "<u4")
    for x, k in zip(rows, (4 * first).tolist(), strict=True):
        ranks[k : k + len(x)] = x
    size = (1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).reshape(-1, 4)
    control = ((size - 1) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size.reshape(-1, 1)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size.sum(axis=1, dtype=np.int64))])
    spans = zip(first.tolist(), (first + quads).tolist(), ends[first].tolist(), ends[first + quads].tolist(), strict=True)
    return [(control[c:d], data[k:n]) for c, d, k, n in spans]


def decode_ranks(control: list[bytes], data: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """The ranks of each row again: each control byte's table rows give the places of its four ranks."""
    c = np.frombuffer(b"".join(control), np.uint8)
    begin = np.cumsum(TOTALS[c]) - TOTALS[c]
    at = (begin[:, None] + OFFSETS[c]).reshape(-1)
    four = np.frombuffer(b"".join(data) + b"\0\0\0\0", np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(four, 4)[at].view("<u4").reshape(-1)
    ranks = words & MASKS[LENGTHS[c].reshape(-1) - 1]
    first = np.cumsum([4 * len(x) for x in control]) - [4 * len(x) for x in control] if control else []
    return [ranks[k : k + n] for k, n in zip(first, counts, strict=True)]


def _counted(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids, counts) of ``docs`` (doc_id, text), and a last row of each task with the frequencies of its ids in ``counts``.

    Ids take two bytes each where they fit; n_tokens and the length tell which.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total, names = encoder(path), np.zeros(0, np.int64), ["doc_id", "n_tokens", "ids", "counts"]
        kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
        for b in grouped(batches, 1):
            at, flat = enc.encode(b.column(1), end_id)
            n = np.bincount(flat, minlength=len(total))
            n[: len(total)] += total
            total = n
            if len(flat) and flat.max() < 1 << 16:
                flat = flat.astype("<u2")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), as_binary(at, flat), pa.nulls(b.num_rows, kind)], names)
        if len(seen := np.flatnonzero(total)):
            each = pa.StructArray.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), each)], names)

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts array<struct<id:long,n:long>>")


def _bounds(keys: DataFrame, n_rows: int, parts: int) -> list[tuple[int, int]]:
    """Upper (key, hash) of all of ``parts`` ranges but the last, from a sample of the keys as large as Spark's own range partitioning takes."""
    wanted = min(100 * parts, 1_000_000)
    some = keys if n_rows <= wanted else keys.sample(fraction=wanted / n_rows, seed=1)
    found = sorted({(r[0], r[1]) for r in some.collect()})
    return [found[len(found) * k // parts] for k in range(1, parts)] if found else []


def _part_of(keys: np.ndarray, hashes: np.ndarray, bound_keys: np.ndarray, bound_hashes: np.ndarray) -> np.ndarray:
    """The range of each (key, hash): the number of bounds at or below it. Hashes matter where a bound has the same key."""
    low, high = (np.searchsorted(bound_keys, keys, side) for side in ("left", "right"))
    for k in np.flatnonzero(low < high):
        low[k] += np.searchsorted(bound_hashes[low[k] : high[k]], hashes[k], "right")
    return low


def write_ids(docs: DataFrame, path: str, *, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts and write them, in ascending doc_id order, in the format above.

    Ids must be below 2**24 (the rank table, at most one row per id of the vocabulary, goes to each
    task). Null and empty texts are documents of the end id alone; rows that repeat a doc_id are
    written each, a null doc_id comes first. An empty table writes a table without rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw = materialize(_counted(rows, tokenizer or default_tokenizer(), end_id).withColumn("h", F.xxhash64("ids")), "ids")
    sums = raw.where("counts is not null").select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(((r["n"], r["id"]) for r in sums.collect()), key=lambda x: (-x[0], x[1]))  # at most the vocabulary
    ids = [x[1] for x in ranked]
    spark.createDataFrame([*enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    # Ranges of (doc_id, hash of the ids), so that rows of one id are dealt too; bounds are found on these two columns alone.
    rows = raw.where("counts is null").withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows.select("key", "h"), rows.count(), parts)
    shared = spark.sparkContext.broadcast((rank_of, *(np.array([b[k] for b in bounds], np.int64) for k in range(2))))
    names = ["part", "doc_id", "n_tokens", "control", "data"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, *limits = shared.value
        for b in batches:
            key, h = (b.column(k).to_numpy() for k in (3, 4))
            both = encode_ranks([table[np.frombuffer(x, f"<u{len(x) // n}")] for n, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(_part_of(key, h, *limits).astype(np.int32)), b.column(0), b.column(1), *(pa.array([x[k] for x in both], pa.binary()) for k in range(2))], names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            n = b.column(2).to_numpy()
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(start), *b.columns[2:]], [*names[:2], "start_in_part", *names[2:]])

    coded = rows.select("doc_id", "n_tokens", "ids", "key", "h").mapInArrow(code, "part int, doc_id long, n_tokens long, control binary, data binary")
    ranges = coded.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", F.xxhash64("data", "control"))
    ranges.mapInArrow(place, "part int, doc_id long, start_in_part long, n_tokens long, control binary, data binary").write.parquet(f"{path}/ids")
    discard(raw)
    sizes = spark.read.parquet(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    before.coalesce(1).write.parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of files that ``write_ids`` has written; ids as little-endian uint32."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # at most the vocabulary
    ids = np.zeros(len(ranks), "<u4")
    for r in ranks:
        ids[r["rank"]] = r["id"]
    before = {r["part"]: r["before"] for r in spark.read.parquet(f"{path}/parts").collect()}  # a row for each part
    shared = spark.sparkContext.broadcast((ids, before))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = shared.value
        for b in batches:
            part, doc_id, at, n, control, data = (b.column(k).to_pylist() for k in range(6))
            rows = [table[x].tobytes() for x in decode_ranks(control, data, n)]
            start = [base[p] + x for p, x in zip(part, at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in ((doc_id, pa.int64()), (start, pa.int64()), (n, pa.int64()), (rows, pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{path}/ids").select("part", "doc_id", "start_in_part", "n_tokens", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op9_ranked_vbyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the whole documents table and reads the files back; digests of the ids replace the ids."""
    path = fresh_path(spark, "tokens")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
