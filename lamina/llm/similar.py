"""Near copies by the Jaccard similarity of word shingles, found by SimHash with multi-index hashing.

A text gets a wide SimHash of its set of five-word shingles, cut into segments. A table names the texts with each segment's
value, each text looks up the Hamming ball of radius 1 of each of its segments, and complete distances verify what it meets. A
quarter of the bits may differ there: at similarity 0.8 about 15 in 100 do, of unrelated texts half. The true
similarity of what is left decides, so no pair below the threshold links.

Two texts at similarity s differ in each bit with probability p = acos(2s / (1 + s)) / pi, so a segment of w bits is within the
ball with q = (1 - p)^w + w p (1 - p)^(w-1), and a pair meets in one of S segments with 1 - (1 - q)^S. The width grows
with the logarithm of the number of texts, so that a text meets a few others by chance however many there are; the
number of segments follows, so that a pair at the threshold meets with probability RECALL (at 0.85 with over 0.999).

Texts equal but for case and white space are one node from the start. Where over FEW nodes hold or look up a value, they are first
compared with one of them only, in STARS values each; then the nodes that classes keep are compared in pairs where BUCKET or fewer
meet. Nodes that meet in larger numbers even then are compared exactly by their rarest shingles: two sets at the threshold
share one of the first n - ceil(0.8 n) + 1 of each, in an order that all sets have in common.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import discard, materialize
from .components import components
from .tokens import short_batches

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99
#: Nodes that meet in a value and are paired at once, and once classes have come down to one node.
FEW, BUCKET = 4, 64
#: Values, those where most meet, in which a node is compared with one of the others only.
STARS = 8
#: Bits of the filter that tells which values nobody holds; it is broadcast, whatever the table's size.
FILTER_BITS = 27
#: Shingles whose bits are counted at once, so that a count fits a byte.
CHUNK = 255
_MIX = [(np.uint64(s), np.uint64(m)) for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))]


@dataclass(frozen=True)
class Shape:
    """Bits of a segment and number of segments."""

    width: int
    segments: int

    @property
    def words(self) -> int:
        """64-bit words of a fingerprint."""
        return -(-self.width * self.segments // 64)

    @property
    def radius(self) -> int:
        """Bits that may differ between complete fingerprints."""
        return 64 * self.words // 4


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Shape:
    """That of ``n`` texts: 2^7.5 values or more for each text, and as many segments as ``recall`` at the threshold needs."""
    width = max(12, math.ceil(math.log2(max(n, 2)) + 7.5))
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    q = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return Shape(width, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(w: list[bytes], size: int = SHINGLE) -> set[bytes]:
    """Fewer words than a shingle are one shingle; no words are none."""
    if len(w) <= size:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[k:] for k in range(size)), strict=False)))


def fingerprint(grams: set[bytes], n_words: int) -> np.ndarray:
    """Bits of the SimHash, ``n_words`` times 64: one is 1 if over half of the shingles set it in their hash."""
    from xxhash import xxh64_intdigest

    salts = np.random.default_rng(5).integers(1, 1 << 63, n_words, dtype=np.uint64)
    hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams))
    counts = np.zeros(64 * n_words, np.int64)
    for k in range(0, len(hashes), CHUNK):
        z = hashes[k : k + CHUNK, None] + salts
        for shift, factor in _MIX:
            z = (z ^ (z >> shift)) * factor
        z ^= z >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return 2 * counts > len(hashes)


def _marked(docs: DataFrame, form: Shape) -> DataFrame:
    """(doc_id, h, node, n, fp) for each row: node names its words, n counts its shingles, fp is the fingerprint."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            nodes, sizes, fps = [], [], []
            for t in b.column(2).to_pylist():
                w = words(t)
                grams = shingles(w)
                nodes.append(int.from_bytes(xxh64_intdigest(b" ".join(w), 42).to_bytes(8, "big"), "big", signed=True))
                sizes.append(len(grams))
                fps.append(np.packbits(fingerprint(grams, form.words)).view(np.int64) if grams else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "h", "node", "n", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, node long, n long, fp array<long>")


def _keys(b: pa.RecordBatch, form: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, keys) of rows (node, fp): a row of keys for each node with words, a segment's number above its value."""
    b = b.filter(pa.compute.greater(pa.compute.list_value_length(b.column(1)), 0))
    fp = b.column(1).flatten().to_numpy().reshape(-1, form.words)
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1)[:, : form.segments * form.width]
    values = bits.reshape(-1, form.segments, form.width) @ (np.int64(1) << np.arange(form.width))
    return b.column(0).to_numpy(), values + (np.arange(form.segments) << form.width)


def _slots(keys: np.ndarray) -> np.ndarray:
    """The two places of each key in the filter."""
    z = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in _MIX:
            z = (z ^ (z >> shift)) * factor
    return np.stack([z >> np.uint64(64 - FILTER_BITS), z & np.uint64((1 << FILTER_BITS) - 1)]).astype(np.int64)


def _filter(slots: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS in which the places of ``slots`` (part, bit: 2^15 bits to a part) are set."""
    got = slots.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS - 15, 1 << 12), np.uint8)
    for part, bits in zip(got["part"].to_pylist(), got["bits"].to_pylist(), strict=True):
        out[part] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _placed(keys: np.ndarray) -> pa.RecordBatch:
    at = _slots(keys).ravel()
    return pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array(at & 0x7FFF)], ["part", "bit"])


def _met(nodes: DataFrame, form: Shape) -> DataFrame:
    """(key, node, holds, k, c): who holds or looks up a value, at distance 1, that two or more do and one holds; k counts them, c is
    one of those that hold it. Of two values that differ in a bit, that with the bit set looks up the other.

    Twice a filter of the values that matter goes to the tasks, so that little else is shuffled: of all values held, then of those
    where nodes meet.
    """
    spark = nodes.sparkSession
    prints = nodes.select("node", "fp")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _placed(_keys(b, form)[1].ravel())

    def meet(shared, exact) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there = shared.value

            def some(node: np.ndarray, keys: np.ndarray, holds: bool, check: bool) -> pa.RecordBatch:
                if check:
                    at = _slots(keys)
                    good = (there[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)
                    node, keys = node[good], keys[good]
                return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), pa.array(np.full(len(keys), holds))], ["key", "node", "holds"])

            for b in batches:
                own, keys = _keys(b, form)
                node, keys = np.repeat(own, form.segments), keys.ravel()
                yield some(node, keys, True, exact)
                for bit in range(form.width):
                    has = keys >> bit & 1 != 0
                    yield some(node[has], keys[has] ^ (1 << bit), False, True)

        return prints.mapInArrow(run, "key long, node long, holds boolean")

    def useful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _placed(b.column(0).to_numpy())

    first = spark.sparkContext.broadcast(_filter(prints.mapInArrow(held, "part int, bit long")))
    salted = F.when(F.col("holds"), F.struct(F.xxhash64("node", F.pmod("key", F.lit(4))).alias("x"), "node"))
    counts = meet(first, False).groupBy("key").agg(F.count("*").alias("k"), F.min(salted).alias("m"))
    counts = materialize(counts.where("k > 1 and m is not null").select("key", "k", F.col("m.node").alias("c")), "values")
    again = spark.sparkContext.broadcast(_filter(counts.select("key").mapInArrow(useful, "part int, bit long")))
    met = materialize(meet(again, True).join(counts, "key"), "met")
    discard(counts)
    return met


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b) with a < b from (a, b) in any order."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of nodes (node, least)."""
    at = wanted.select("node", F.col("least.doc_id").alias("d"), F.col("least.h").alias("dh"))
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"), "text")
    return rows.join(at, F.col("k").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh"))).groupBy("node").agg(F.first("text").alias("text"))


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float, form: Shape) -> DataFrame:
    """Those of ``pairs`` whose fingerprints are within the shape's radius and whose shingles have a Jaccard similarity of ``threshold`` or more."""
    one, two = (nodes.select(F.col("node").alias(x), F.col("fp").alias(f"f{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    both = pairs.distinct().join(one, "a").join(two, "b")
    bits = sum((F.bit_count(F.col("fa")[k].bitwiseXOR(F.col("fb")[k])) for k in range(form.words)), F.lit(0))
    close = both.where((bits <= form.radius) & (F.least("na", "nb") / F.greatest("na", "nb") >= threshold))
    pairs = materialize(close.select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = materialize(_texts(docs, nodes.join(wanted, "node", "left_semi")), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for b in batches:
            good = []
            for x, s, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if x != last:
                    last, left = x, shingles(words(s))
                right = shingles(words(t))
                common = len(left & right)
                good.append(common / (len(left) + len(right) - common) >= threshold)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    found = materialize(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "similar")
    discard(pairs)
    discard(texts)
    return found


def _kept(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, least) of the row each class keeps."""
    classes = nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return classes.groupBy("root").agg(F.min(F.struct("least", "node")).alias("x")).select("x.node", "x.least")


def _rare_pairs(docs: DataFrame, some: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of nodes (node, least) that share one of the rarest shingles of both, as all at ``threshold`` or more do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grams = shingles(words(t))
                h = np.fromiter((xxh64_intdigest(g, 7) for g in grams), np.uint64, len(grams)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node)), pa.array(np.full(len(h), len(h))), pa.array(h)], ["node", "n", "g"])

    grams = materialize(_texts(docs, some).mapInArrow(run, "node long, n long, g long"), "grams")
    common = grams.groupBy("g").agg(F.count("*").alias("f"))
    placed = grams.join(common, "g").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("f", "g")))
    first = placed.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("f") > 1)).select("g", "node", "n", "at")
    first = materialize(first, "rare")
    one, two = (first.select("g", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "at"))) for x in "ab")
    # What follows the first shingle in common bounds all they have in common.
    most = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.col("node_a") < F.col("node_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (most >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")))
    pairs = materialize(one.join(two, (one["g"] == two["g"]) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "rare-pairs")
    discard(grams)
    discard(first)
    return pairs


def keep_one(docs: DataFrame, *, threshold: float = THRESHOLD, bucket: int = BUCKET, few: int = FEW) -> DataFrame:
    """One row of each class of near copies in ``docs`` (doc_id, text), with all its columns: that of the smallest doc_id.

    A class is linked by pairs of similar texts; no two rows that stay are similar, as far as segments meet. Of rows that share a
    doc_id, the one with the smallest hash of its text stays, and of exact repeats one. Texts without words are one
    class; null ids come last, and a class of null ids keeps one row. An empty table gives no rows.
    """
    form, few = shape(docs.count(), threshold), min(few, bucket)
    marked = materialize(_marked(docs, form), "marked")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    nodes = materialize(marked.groupBy("node").agg(F.min(rank).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp")), "nodes")
    discard(marked)
    met = _met(nodes, form)

    def paired(rows: DataFrame) -> DataFrame:
        """Pairs of nodes that meet in a value which one of them holds."""
        holders = rows.where("holds").select("key", F.col("node").alias("b"))
        return _ordered(rows.select("key", F.col("node").alias("a")).join(holders, "key"))

    def stars(rows: DataFrame) -> DataFrame:
        """Pairs of nodes and those that stand for the values where most others meet them."""
        most = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("k"), "key"))
        return _ordered(rows.withColumn("r", most).where(F.col("r") <= STARS).select(F.col("node").alias("a"), F.col("c").alias("b")))

    links = _similar(docs, nodes, paired(met.where(F.col("k") <= few)).union(stars(met.where(F.col("k") > few))), threshold, form)
    kept = materialize(_kept(nodes.select("node", "least"), links), "kept")
    # Of values where more than a few met, those where two or more of the nodes that stay do.
    left = materialize(met.where(F.col("k") > few).select("key", "node", "holds").join(kept.select("node"), "node", "left_semi"), "left")
    counts = left.groupBy("key").agg(F.count("*").alias("k"), F.max("holds").alias("held")).where("k > 1 and held")
    alive = materialize(left.join(counts.select("key", "k"), "key"), "alive")
    pairs = paired(alive.where(F.col("k") <= bucket))
    crowd = materialize(alive.where(F.col("k") > bucket).select("node").distinct(), "crowd")
    if not crowd.isEmpty():
        pairs = pairs.union(_rare_pairs(docs, kept.join(crowd, "node"), threshold))
    more = _similar(docs, nodes, pairs, threshold, form)
    if not more.isEmpty():
        kept = materialize(_kept(kept, more), "kept")
    for x in (met, left, alive, crowd):
        discard(x)
    best = kept.select(F.col("least.doc_id").alias("d"), F.col("least.h").alias("dh"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"))
    found = rows.join(best, F.col("k").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")), "left_semi")
    one = F.row_number().over(Window.partitionBy("k", "h").orderBy(F.lit(1)))
    return found.withColumn("r", one).where("r = 1").select("row.*")
