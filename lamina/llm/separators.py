"""Token counts of documents in flat token files that have no index: a scan for end-of-document ids.

A flat file holds big-endian uint16 ids and nothing else; a document ends at its end id. Files are cut
into blocks; numpy finds the end ids of a block at once. A document may begin in one block and end in
another, so each block reports its number of ends and the place of its last end; a prefix scan over
these two numbers per block (running sum, running maximum) says which document its first end closes
and where that document began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import exists, fresh_path
from .tokens import as_binary, default_tokenizer, encoder, grouped, short_batches

#: End-of-document id: above the vocabulary (so that no text makes it) and, as two bytes, the character
#: that Spark's text writer takes as its line separator.
END_ID, END_CHAR = 0xC480, "\u0100"
#: Ids in a block of the scan.
BLOCK_IDS = 1 << 16
#: Pieces a worker remembers, and bytes of text it encodes at once, here, where the JVM sorts a task's ids beside it.
PIECES, BYTES = 300_000, 1 << 20


def write_flat(docs: DataFrame, path: str, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts and write flat files to ``path/kind=tokens``, in one pass and without a shuffle.

    Spark's text writer puts the bytes of each document and the end id as its line separator, so the
    files are committed like any other output, never compressed, and may lie in any store that Spark writes. ``path/kind=order``
    gets, from the same task, a file of the same name with the documents' ids in the same order. Null and empty
    texts become documents without ids; repeated rows are written each. The vocabulary must lie below 50304.
    """
    file = tokenizer or default_tokenizer()
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(file, PIECES), 0
        for b in grouped(batches, 1, BYTES):
            ends, flat = enc.encode(b.column(1))
            if len(flat) and flat.max() >= END_ID:
                raise ValueError(f"ids must be below {END_ID}")
            names = [b"" if x is None else str(x).encode() for x in b.column(0).to_pylist()]
            n = b.num_rows
            kind, row = ["tokens"] * n + ["order"] * n, [*range(at, at + n)] * 2
            values = pa.concat_arrays([as_binary(ends, flat.astype(">u2")), pa.array(names, pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(row, pa.int64()), values], ["kind", "row", "value"])
            at += n

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "kind string, row long, value binary")
    lines = out.sortWithinPartitions("kind", "row").select("kind", F.col("value").cast("string").alias("value"))
    lines.write.partitionBy("kind").option("lineSep", END_CHAR).option("compression", "none").text(path)


def scan_flat(spark: SparkSession, path: str, *, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, row, start, n_tokens, ended): every document of the flat files below ``path``, in file order.

    n_tokens does not count the end id. Ids after a file's last end id are one more row with ended false;
    an empty file has no rows. A file of an odd number of bytes is an error.
    """
    short_batches(spark)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = [np.frombuffer(x, ">u2") for x in b.column(2).to_pylist()]
            at = [np.flatnonzero(x == end_id) + k * block_ids for x, k in zip(blocks, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in blocks], pa.int64()), pa.array([x.tolist() for x in at], pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    size = 2 * block_ids
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    whole = F.when(F.col("length") % 2 == 1, F.raise_error(F.lit("a flat file holds two bytes for each id"))).otherwise(F.col("length"))
    files = files.select("path", "content", whole.alias("length")).where("length > 0")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.col("length") / size).cast("int") - 1), lambda k: F.substring(F.col("content"), k * size + 1, F.lit(size)))
    blocks = files.select(F.col("path").alias("file"), F.posexplode(cut).alias("block", "bytes"))
    found = blocks.mapInArrow(ends, "file string, block int, n long, ends array<long>")
    # The prefix scan: two numbers for each block of a file.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("last", F.max(F.try_element_at("ends", F.lit(-1))).over(earlier))
    found = found.withColumn("before", F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0))).withColumn("last", F.coalesce("last", F.lit(-1)))
    found = found.withColumn("final", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    total = F.col("block") * F.lit(block_ids).cast("long") + F.col("n")
    since = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("last"))
    closed = F.zip_with(F.concat(F.array("last"), F.col("ends")), F.col("ends"), lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n_tokens"), F.lit(True).alias("ended")))
    closed = F.filter(closed, lambda x: x["n_tokens"].isNotNull())
    rest = F.when(F.col("final") & (total - since > 1), F.array(F.struct((since + 1).alias("start"), (total - since - 1).alias("n_tokens"), F.lit(False).alias("ended"))))
    each = F.concat(closed, F.coalesce(rest, F.slice(closed, 1, 0)))
    return found.select("file", "before", F.posexplode(each).alias("k", "x")).select("file", (F.col("before") + F.col("k")).alias("row"), "x.start", "x.n_tokens", "x.ended")


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): writes the flat files to ``path`` and counts by scanning them.

    Null and empty texts count 0; a null doc_id stays; repeated rows count each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    write_flat(docs, path, tokenizer=tokenizer, id_col=id_col, text_col=text_col)
    if not exists(spark, f"{path}/kind=order"):  # no document
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    name = lambda c: F.substring_index(c, "/", -1).alias("name")
    order = spark.read.format("binaryFile").load(f"{path}/kind=order")
    parts = F.split(F.col("content").cast("string"), END_CHAR)  # nothing follows the last end
    order = order.select(name("path"), F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("row", "id"))
    order = order.select("name", F.col("row").cast("long").alias("row"), F.col("id").try_cast("long").alias("doc_id"))
    counts = scan_flat(spark, f"{path}/kind=tokens").select(name("file"), "row", "n_tokens")
    n = F.coalesce("n_tokens", F.raise_error(F.concat(F.lit("a document has no end id in "), "name")).cast("long"))
    return order.join(counts, ["name", "row"], "left").select("doc_id", n.alias("n_tokens"))


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, counted in flat files."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "flat"))
