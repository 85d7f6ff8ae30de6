"""Passages that repeat across documents, by a sparse suffix array over words.

Only suffixes at minimiser positions are kept: the word with the smallest hash of the 6 words from it on,
among every 24 neighbours. What selects a position is the text around it, so two copies of a passage of 50
words share one at the same place, with at least 27 words of the passage to its right. The suffixes
are sorted (by the hash of their first 27 words, then of their first 74) and each is compared with
its neighbours: a run of equal 27 words with two documents in it is a candidate, a run of equal 74 words is a
repeat that needs no further look. Candidates are extended left and right: the 50-word windows that hold
such a position are compared, so the spans returned are exactly the words of all 50-word windows that
occur in two documents.

Where long repeats already cover the windows around every suffix of a run, the run isn't extended: long copies cost
their edges only. Runs are cut by the sort like any other rows; what two parts of a run say of each other
is settled from the first and last run of each part, a few rows per part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import discard, materialize
from .tokens import short_batches

MIN_WORDS, RUN, GRAM = 50, 24, 6
#: Words that a shared window leaves to the right of a minimiser, and words that hold all windows up to the next.
SHORT, LONG = MIN_WORDS - RUN + 1, MIN_WORDS + RUN
#: Odd bases of two rolling hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of all word ranges of a text; two independent ones."""

    def __init__(self, text: str | None):
        from xxhash import xxh3_64_intdigest

        words = text.encode("utf-8", "surrogatepass").split() if text else []
        self.n = len(words)
        h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, self.n)
        self.sums, self.back = [], []
        for base in BASES:
            power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(self.n, base, np.uint64))])
            inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(self.n, pow(base, -1, 1 << 64), np.uint64))])
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)]))
            self.back.append(inverse)

    def of(self, at: np.ndarray, size: int, which: int) -> np.ndarray:
        s = self.sums[which]
        return (s[at + size] - s[at]) * self.back[which][at]

    def minimisers(self) -> np.ndarray:
        grams = self.of(np.arange(max(0, self.n - GRAM + 1)), GRAM, 0)
        if len(grams) < RUN:
            return np.zeros(0, np.int64)
        grams = grams ^ grams >> np.uint64(31)
        return np.unique(np.lib.stride_tricks.sliding_window_view(grams, RUN).argmin(axis=1) + np.arange(len(grams) - RUN + 1))


def _suffixes(docs: DataFrame) -> DataFrame:
    """(k1, k2, rid, pos): suffixes at minimisers with SHORT words; k2 is 0 with fewer than LONG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                roll = Rolling(text)
                if roll.n < MIN_WORDS:
                    continue
                pos = roll.minimisers()
                pos = pos[pos + SHORT <= roll.n]
                k2 = np.zeros(len(pos), np.uint64)
                far = pos + LONG <= roll.n
                k2[far] = roll.of(pos[far], LONG, 1) | np.uint64(1)
                for c, x in zip(cols, (roll.of(pos, SHORT, 0).view(np.int64), k2.view(np.int64), np.full(len(pos), rid), pos), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in cols], ["k1", "k2", "rid", "pos"])

    return docs.mapInArrow(run, "k1 long, k2 long, rid long, pos long")


def _runs(keys: list[np.ndarray], rid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: the run of each, and the smallest and largest document of each run."""
    new = np.zeros(len(rid), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    of, start = np.cumsum(new), np.flatnonzero(np.concatenate([[True], new[1:]]))
    return of, np.minimum.reduceat(rid, start), np.maximum.reduceat(rid, start)


def _neighbours(suffixes: DataFrame) -> DataFrame:
    """(k1, rid, pos, long) of the suffixes whose first SHORT words begin a suffix of another document too.

    Sorted parts compare each row with its neighbours; runs that reach a part's edge are settled after.
    """
    spark = suffixes.sparkSession

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches([*batches], schema=pa.schema([(c, pa.int64()) for c in ("k1", "k2", "rid", "pos")]))
        if not whole.num_rows:
            return
        k1, k2, rid, pos = (whole.column(c).to_numpy() for c in range(4))
        part, n = TaskContext.get().partitionId(), len(pos)
        of1, low1, high1 = _runs([k1], rid)
        of2, low2, high2 = _runs([k1, k2], rid)
        one, two = (low1 < high1)[of1], (low2 < high2)[of2] & (k2 != 0)
        # An edge run's rows all stay, with what is needed to settle it.
        edge1, edge2 = (of1 == 0) | (of1 == of1[-1]), (of2 == 0) | (of2 == of2[-1])
        keep = np.flatnonzero(one | edge1)
        for at in range(0, len(keep), 50_000):
            k = keep[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), part)), *(pa.array(x[k]) for x in (k1, k2, rid, pos, one, two, edge1, edge2))], ["part", "k1", "k2", "rid", "pos", "one", "two", "edge1", "edge2"])

    order = ["k1", "k2", "rid", "pos"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = materialize(sorted_.mapInArrow(compare, "part long, k1 long, k2 long, rid long, pos long, one boolean, two boolean, edge1 boolean, edge2 boolean"), "suffixes")
    settled = {}
    for name, keys in (("1", ["k1"]), ("2", ["k1", "k2"])):  # two runs for each part, at most
        ends = rows.where(f"edge{name}").groupBy("part", *keys).agg(F.min("rid").alias("low"), F.max("rid").alias("high"))
        settled[name] = ends.groupBy(*keys).agg((F.min("low") < F.max("high")).alias(f"both{name}"))
    out = rows.join(F.broadcast(settled["1"]), "k1", "left").join(F.broadcast(settled["2"]), ["k1", "k2"], "left")
    one = F.col("one") | F.coalesce(F.col("edge1") & F.col("both1"), F.lit(False))
    two = F.col("two") | F.coalesce(F.col("edge2") & F.col("both2") & (F.col("k2") != 0), F.lit(False))
    return materialize(out.where(one).select("k1", "rid", "pos", two.alias("long")), "candidates")


def _uncovered(found: DataFrame) -> DataFrame:
    """``found`` with ``open``: whether some window that holds the position is not inside the long repeats of its document."""
    by = Window.partitionBy("rid").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    long_pos = F.when(F.col("long"), F.col("pos"))
    rows = found.withColumn("last", F.last(long_pos, ignorenulls=True).over(before))
    begins = F.col("long") & (F.col("last").isNull() | (F.col("pos") - F.col("last") > RUN + 1))
    rows = rows.withColumn("chain", F.last(F.when(begins, F.col("pos")), ignorenulls=True).over(upto))
    rows = rows.withColumn("near", F.last(long_pos, ignorenulls=True).over(upto))
    covered = (F.col("near") + RUN >= F.col("pos")) & (F.col("chain") <= F.greatest(F.lit(0), F.col("pos") - RUN + 1))
    return rows.select("k1", "rid", "pos", "long", (~F.coalesce(covered, F.lit(False))).alias("open"))


def _windows(texts: DataFrame) -> DataFrame:
    """(rid, start, a, b): hashes of the MIN_WORDS words from each start whose window holds one of the positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for rid, text, pos in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                roll = Rolling(text)
                hit = np.zeros(roll.n + 1, np.int64)
                p = np.array(pos)
                np.add.at(hit, np.maximum(0, p - RUN + 1), 1)
                np.add.at(hit, p + 1, -1)
                at = np.flatnonzero(np.cumsum(hit)[: max(0, roll.n - MIN_WORDS + 1)])
                for c, x in zip(cols, (np.full(len(at), rid), at, roll.of(at, MIN_WORDS, 0).view(np.int64), roll.of(at, MIN_WORDS, 1).view(np.int64)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in cols], ["rid", "start", "a", "b"])

    return texts.mapInArrow(run, "rid long, start long, a long, b long")


def merged(pieces: Column) -> Column:
    """Sorted (start, end) structs joined where they touch."""
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(pieces, none, add)


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, n_repeated) for each row with words of a 50-word window that occurs in another document.

    spans: sorted, disjoint (start, end) in words, end excluded; words are runs without ASCII white space.
    Null, empty and shorter texts have no windows. Rows that share doc_id and text are one document, and each
    returns its spans; rows that share only one of the two are different documents. Without repeats (an
    empty table too) there are no rows. Other columns are not read.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    found = _neighbours(_suffixes(rows.select("rid", "text")))
    marked = materialize(_uncovered(found), "marked")
    open_keys = materialize(marked.where("open").select("k1").distinct(), "open")  # written, so that a hot key's rows can be split in the join
    active = marked.join(open_keys, "k1", "left_semi")
    places = active.groupBy("rid").agg(F.collect_set("pos").alias("pos"))  # at most the words of a document
    texts = rows.select("rid", "text").join(places, "rid").dropDuplicates(["rid"])
    windows = materialize(_windows(texts.select("rid", "text", "pos")), "windows")
    twice = windows.groupBy("a", "b").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high").select("a", "b")
    twice = materialize(twice, "twice")
    short = windows.join(twice, ["a", "b"], "left_semi").select("rid", F.struct("start", (F.col("start") + MIN_WORDS).alias("end")).alias("x"))
    long = marked.where("long").select("rid", F.struct(F.col("pos").alias("start"), (F.col("pos") + LONG).alias("end")).alias("x"))
    spans = short.union(long).groupBy("rid").agg(merged(F.array_sort(F.collect_set("x"))).alias("spans"))
    spans = spans.withColumn("n_repeated", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]))
    out = materialize(spans, "spans")
    for done in (found, marked, open_keys, windows, twice):
        discard(done)
    return rows.select("doc_id", "rid").join(out, "rid").select("doc_id", "spans", "n_repeated")


def op5_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of the whole documents table; spans as text, ``start-end`` in words."""
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "n_repeated", F.size("spans").cast("long").alias("n_spans"), text.alias("spans"))


ORACLE_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM doc WHERE len(w) >= 50) x),
hit AS (SELECT doc_id, i FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(DISTINCT doc_id) > 1)),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
island AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mark),
span AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM island GROUP BY doc_id, k)
SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_repeated, count(*) AS n_spans,
       string_agg(concat(CAST(s AS VARCHAR), '-', CAST(e AS VARCHAR)), ',' ORDER BY s) AS spans
FROM span GROUP BY doc_id
"""
