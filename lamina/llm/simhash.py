"""Near-duplicate classes by SimHash, found with multi-index hashing.

Each document gets a 64-bit SimHash of its word shingles; fingerprints link at a few differing bits and
classes are the connected components. Copies share a fingerprint, so all later work is on distinct
fingerprints.

Multi-index hashing: a fingerprint is cut into two segments of 32 bits. Two fingerprints at distance 3 or
less have a segment at distance 1 or less, so each fingerprint looks up the Hamming ball of radius 1 of each
of its segments in a table of segments, and complete distances verify what it meets.

A segment value that many fingerprints share would let its bucket meet itself in all pairs. Such a bucket
is linked through its other segments instead: two of them within distance r lie within ceil(r/2) and
floor(r/2) of a common 32-bit word, so its fingerprints meet at the words around them, and a word's members
link to one of them: links grow with the members, none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import discard, materialize
from .components import components
from .tokens import short_batches

#: Fingerprints that may share a segment value and still be compared one with another.
BUCKET = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half the XXH64 (seed 42) values of the shingles.

    A-Z are lower-cased; words are runs without ASCII white space; repeated shingles count each time.
    Fewer words than a shingle are one shingle; no words (null too) give 0.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        counts += np.unpackbits(hashes[k : k + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp): h is the xxhash64 of the text, fp the fingerprint as a signed 64-bit number."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "h", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


def _ball(radius: int) -> Column:
    """Masks of 32 bits with at most ``radius`` bits set, as (mask, bits)."""
    masks = [(sum(1 << b for b in c), len(c)) for r in range(radius + 1) for c in combinations(range(32), r)]
    return F.expr("array(" + ",".join(f"named_struct('m',{m}L,'e',{e})" for m, e in masks) + ")")


def links(fps: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that leave the same components as all pairs at distance 3 or less.

    Spark doesn't count the rows that ``explode`` makes, so it would take a side with a ball for each fingerprint for a small
    table and send it through the driver: such joins are merges.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    index = fps.select("fp", F.explode(F.array(high, low.bitwiseOR(F.lit(1 << 32)))).alias("key"))  # bit 32 names the segment
    other = lambda fp: F.when(F.col("key") < (1 << 32), F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
    hot = materialize(index.groupBy("key").count().where(F.col("count") > bucket).select("key"), "hot")
    probes = index.select(F.col("fp").alias("a"), "key", F.explode(_ball(1)).alias("x")).select("a", F.col("key").bitwiseXOR(F.col("x.m")).alias("key"))
    table = index.withColumnRenamed("fp", "b")
    near = probes.join(table.join(hot, "key", "left_anti").hint("merge"), "key")
    near = near.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)).select("a", "b")
    if hot.isEmpty():
        return near
    # Within a hot bucket members give the words within 1 of their other segment, probes those within 2, less what they spent.
    members = table.join(hot, "key", "left_semi").select("key", "b", F.explode(_ball(1)).alias("x"))
    members = members.select("key", other("b").bitwiseXOR(F.col("x.m")).alias("word"), "b").groupBy("key", "word").agg(F.min("b").alias("b"))
    seekers = probes.join(hot, "key", "left_semi")
    own = F.when(F.col("key") < (1 << 32), F.shiftrightunsigned("a", 32)).otherwise(F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32)))
    around = F.when(own == F.col("key"), _ball(2)).otherwise(_ball(1))
    seekers = seekers.select("key", "a", F.explode(around).alias("x")).select("key", other("a").bitwiseXOR(F.col("x.m")).alias("word"), "a")
    return near.union(seekers.join(members.hint("merge"), ["key", "word"]).where("a <> b").select("a", "b"))


def _classed(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(marked, classes): marked has doc_id, h and fp of each row, classes the root of each distinct fp."""
    marked = materialize(fingerprints(docs, **options), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min(_rank()).alias("least")), "distinct")
    found = materialize(links(fps.select("fp")).distinct(), "links")
    roots = components(found)  # of fingerprints with links only
    discard(found)
    return marked, fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _rank() -> Column:
    """Orders rows by doc_id, nulls last, then by the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest doc_id reachable through links, its own included.

    Options: shingle, id_col, text_col. Texts without words (null, empty) share fingerprint 0 and link like
    any other. Repeated rows share a class; null doc_ids keep their class but never name it (a class of null
    ids alone has a null component_id). An empty table gives no rows. Other columns are not read.
    """
    marked, classes = _classed(docs, **options)
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = classes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs`` (doc_id, text), with all its columns: that of the smallest doc_id.

    Of rows that share it, the one with the smallest hash of its text stays, and of exact repeats one. Texts
    without words are one class; null ids come last, and a class of null ids keeps one row.
    """
    _, classes = _classed(docs)
    best = classes.groupBy("root").agg(F.min("least").alias("x")).select(F.col("x.doc_id").alias("d"), F.col("x.h").alias("dh"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"))
    kept = rows.join(best, F.col("k").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")), "left_semi")
    first = F.row_number().over(Window.partitionBy("k", "h").orderBy(F.lit(1)))
    return kept.withColumn("n", first).where("n = 1").select("row.*")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the whole documents table."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
