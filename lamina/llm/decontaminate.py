"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides keep, of every run of 8 neighbouring 6-word grams, the one with the smallest hash (that of its
first word leads; of equal ones the leftmost stays). Every window of 13 words holds such a run, so a window
shared by a document and a benchmark item leaves a shared fingerprint in both. Where a document's
fingerprint meets one of the benchmark, the hit is extended to the windows that hold it, and these are
compared with the benchmark's, word for word. Items shorter than a window are one window of their own length;
each such length (at most 12) has fingerprints of its own, of grams of half that length.

Texts are read and cut into words once, and are not shuffled: fingerprints stream past the benchmark's, and
only hits go on, with the words around them. A benchmark above ``BROADCAST_BYTES`` is not broadcast;
fingerprints then are shuffled, and the texts of documents that have a hit are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize

WINDOW, GRAM = 13, 6
#: Runs of anything but ASCII signs; these are listed one by one, for which Java's patterns have a table.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
#: Bytes of a table of the benchmark's fingerprints, windows or items, by estimate, that is broadcast at most.
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a position beside 33 bits of a hash.
POSITION = 31


def cut_words(text: Column) -> Column:
    """Words of a whole text as they stand; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased; none for null."""
    return cut_words(F.translate(text, UPPER, LOWER))


def gram_size(length: Column | int) -> Column:
    """Words of the grams for windows of a length: half of it, GRAM at most."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.least(F.lit(GRAM), F.floor((length + 1) / 2).cast("int"))


def _least_of(x: str, run: int) -> Column:
    """For each place of an array the smallest of the ``run`` values from there on, by doubling; fewer at the end."""

    def step(held: Column, by: int) -> Column:
        return F.transform(F.array(held), lambda a: F.transform(a, lambda v, i: F.least(v, F.get(a, i + by))))[0]

    out, size = F.col(x), 1
    while size < run:
        by = min(size, run - size)
        out, size = step(out, by), size + by
    return out


def _chosen(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` (words and others) with ``at``: the places of the fingerprints of each length, as length * 2**31 + position."""
    # 33 bits of each word's hash above its position. lower() takes in more than A-Z: equal words stay equal.
    rows = rows.withColumn("k", F.transform("words", lambda w, i: F.shiftleft(F.xxhash64(F.lower(w)), POSITION).bitwiseOR(i.cast("long"))))
    n = F.size("words")
    for length in lengths:
        rows = rows.withColumn(f"least_{length}", _least_of("k", length - min(GRAM, (length + 1) // 2) + 1))
    none = F.expr("cast(array() as array<bigint>)")
    mask = (1 << POSITION) - 1

    def places(length: int) -> Column:
        kept = F.array_distinct(F.slice(f"least_{length}", F.lit(1), F.greatest(n - (length - 1), F.lit(0))))
        return F.transform(kept, lambda v: v.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(length << POSITION)))

    at = F.concat(none, *(places(x) for x in lengths))
    return rows.withColumn("at", at).drop("k", *(f"least_{x}" for x in lengths))


def _prints(chosen: DataFrame, *, and_rows: bool) -> DataFrame:
    """One row for each fingerprint: words and the other columns, len, pos, hash. and_rows: one without them too for each row."""
    own = F.concat(F.array(F.lit(-1).cast("long")), F.col("at")) if and_rows else F.col("at")
    rows = chosen.select(*(c for c in chosen.columns if c != "at"), F.explode(own).alias("v")).where("v is not null")
    is_print = F.col("v") >= 0
    length = F.when(is_print, F.shiftright("v", POSITION).cast("int"))
    pos = F.when(is_print, F.col("v").bitwiseAND(F.lit((1 << POSITION) - 1)).cast("int"))
    rows = rows.select("*", length.alias("len"), pos.alias("pos"))
    # A space is neither cased nor ignored by case, so that words are lower-cased as each alone.
    gram = F.lower(F.array_join(F.slice("words", F.col("pos") + 1, gram_size(F.col("len"))), " "))
    return rows.select(*(c for c in rows.columns if c != "v"), F.when(is_print, F.xxhash64(gram)).alias("hash"))


def _around() -> tuple[Column, Column]:
    """Where the windows around a fingerprint begin, and the words they take."""
    back = F.col("len") - gram_size(F.col("len"))
    start = F.greatest(F.col("pos") - back, F.lit(0))
    words = F.translate(F.array_join(F.slice("words", start + 1, F.col("len") + back), " "), UPPER, LOWER)
    return start.alias("from"), words.alias("around")


def _fits(table: DataFrame, *texts: str, limit: int) -> bool:
    """Whether a table's rows, at 64 bytes and their texts each, stay within the limit."""
    size = table.agg(F.sum(F.lit(64) + sum((F.octet_length(t) for t in texts), F.lit(0))).alias("size")).first()["size"]
    return (size or 0) <= limit


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, h, n_words, n_hit, hits, items) for each row of ``docs``.

    hits: windows of the benchmark in the document, as sorted (start, length) in words; n_hit: words in any
    of them; items: the item ids (as strings, sorted) whose windows occur. h: xxhash64 of the text.

    Null and empty texts have no words; items without words have no windows; an item with a null id
    marks words but is not listed. Repeated rows each get the result of their text; rows that share a doc_id
    but not a text are apart. Empty tables give no rows, or no hits. Other columns are not read.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("len", F.least(F.size("words"), F.lit(WINDOW)))
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # 13 at most
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), cut_words(F.col(text_col)).alias("words"))
    none = F.expr("cast(array() as array<struct<start:int,length:int>>)"), F.expr("cast(array() as array<string>)")
    base = texts.select("doc_id", "h", F.size("words").cast("long").alias("n_words"))
    if not lengths:
        return base.select("*", F.lit(0).cast("long").alias("n_hit"), none[0].alias("hits"), none[1].alias("items"))

    length = F.col("len")
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    of_items = items.select("item", "len", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, length), " "))).alias("window")).distinct()
    windows = materialize(of_items.select("len", "window").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    members = materialize(of_items.where("item is not null").join(windows, ["len", "window"]).select("w", "item"), "members")
    of_own_length = _prints(_chosen(items.select("words", F.col("len").alias("own")), lengths), and_rows=False).where("len = own")
    prints = materialize(of_own_length.select("len", "hash").distinct().withColumn("met", F.lit(True)), "prints")
    light = lambda table, *texts: F.broadcast(table) if _fits(table, *texts, limit=broadcast_bytes) else table
    small = _fits(prints, limit=broadcast_bytes)

    if small:  # one pass: what has no hit ends as one row with its number of words
        rows = _prints(_chosen(texts, lengths), and_rows=True).join(F.broadcast(prints), ["len", "hash"], "left").where("len is null or met")
        tagged = materialize(rows.select("doc_id", "h", F.when(F.col("len").isNull(), F.size("words").cast("long")).alias("n_words"), "len", *_around()), "tagged")
        base, met = tagged.where("len is null").select("doc_id", "h", "n_words"), tagged.where("len is not null")
    else:
        marks = _prints(_chosen(texts, lengths), and_rows=False).select("doc_id", "h", "len", "hash").join(prints, ["len", "hash"], "left_semi")
        marks = materialize(marks.select(F.col("doc_id").alias("d"), F.col("h").alias("dh")).distinct(), "marks")
        hit = texts.join(marks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")), "left_semi")
        met = _prints(_chosen(hit, lengths), and_rows=False).select("doc_id", "h", "len", "hash", *_around()).join(prints, ["len", "hash"], "left_semi")
    met = met.select("doc_id", "h", "len", "from", F.split("around", " ").alias("around"))
    shifts = F.sequence(F.lit(0), F.size("around") - length)
    tried = F.transform(shifts, lambda s: F.struct((F.col("from") + s).alias("start"), F.array_join(F.slice("around", s + 1, length), " ").alias("window")))
    tried = met.where(F.size("around") >= length).select("doc_id", "h", "len", F.inline(tried))
    found = materialize(tried.join(light(windows, "window"), ["len", "window"]).select("doc_id", "h", "start", "len", "w").distinct(), "found")

    hits = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", length.alias("length")))).alias("hits"))
    empty = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"))

    hits = hits.withColumn("n_hit", F.aggregate("hits", empty, add, lambda acc: acc["n"]))
    # A window's items are looked up once for each document, however often it occurs there.
    listed = found.select("doc_id", "h", "w").distinct().join(light(members, "item"), "w").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select(F.col("doc_id").alias("i"), F.col("h").alias("ih"), "items")
    hits = hits.join(listed, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("ih")), "left").select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), "n_hit", "hits", "items")
    both = base.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")), "left")
    for done in (prints, windows):
        discard(done)
    return both.select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text), with all their columns, that are not contaminated.

    Null ids and texts, repeated rows and empty tables are judged as ``contamination`` says; columns of any name stay.
    """
    gone = contamination(docs, benchmark).where(is_contaminated()).select(F.col("doc_id").alias("d"), F.col("h").alias("dh")).distinct()
    gone = materialize(gone, "contaminated")
    gone = F.broadcast(gone) if _fits(gone, limit=BROADCAST_BYTES) else gone
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"))
    return row.join(gone, F.col("k").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")), "left_anti").select("row.*")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table against the whole benchmark."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), is_contaminated().alias("contaminated"))


ORACLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) x
  WHERE len(w) > 0),
item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item) x),
doc_window AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc CROSS JOIN (SELECT DISTINCT n FROM item) l WHERE len(w) >= n) x),
hit AS (SELECT d.doc_id, d.n, d.i, b.item_id FROM doc_window d JOIN item_window b ON d.n = b.n AND d.t = b.t),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) x GROUP BY doc_id),
list AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN word h ON d.doc_id = h.doc_id LEFT JOIN list l ON d.doc_id = l.doc_id
"""
