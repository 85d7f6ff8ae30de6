"""Hard negatives by exact inner products of integer vectors, with early discards in a rotated space.

Components are scaled and rounded down to integers, so scores are exact. All rows' second moments give an orthogonal rotation
that puts most of their length into the leading components. For a block of rows and a tile of anchors the partial product
over the leading components plus the product of both residual norms (and a slack for rounding) bounds the score from
above; pairs below what an anchor still needs are dropped, the others take in further components, and what survives all
of them is verified by integer products.

Rows are read where they lie, in two passes for each part of the anchors: the best rows of the same label, then, with
the intervals that these set, the best rows of other labels. A task keeps the best of its rows only. Parts of
ANCHORS anchors are broadcast one after the other, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import fresh_path, materialize
from .vectors import matrix, usable

SCALE = 256
#: Anchors that are broadcast at once; those of a tile and rows of a block that are multiplied at once.
ANCHORS, TILE, BLOCK = 8192, 512, 2048
#: Shares of the components after which bounds are compared.
STEPS = (0.25, 0.5, 0.75)
#: If more than this share of the pairs of a tile is left, further components are taken in for all.
DENSE = 0.1


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): one row for each id, components such that no score leaves 64 bits."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    rows = usable(rows.where("vec_id is not null and label is not null"), "v", limit=float(1 << 20))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = rows.repartition(parts, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    return one.select("vec_id", "x.label", "x.v")


def integers(column: pa.Array) -> np.ndarray:
    return np.floor(SCALE * matrix(column)).astype(np.int64)


def rotation(rows: DataFrame) -> np.ndarray:
    """Orthogonal columns, the directions in which the integer vectors of all rows are longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                x = integers(b.column(0).slice(k, BLOCK)).astype(np.float64)
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    sums = rows.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    if not sums.num_rows:
        return np.zeros((0, 0))
    i, j, s = (sums[c].to_numpy() for c in "ijs")
    moments = np.zeros((int(j.max()) + 1,) * 2)
    moments[i, j] = moments[j, i] = s
    return np.linalg.eigh(moments)[1][:, ::-1]


class Turned:
    """Integer vectors, their rotated selves, and the norms of what follows each step's components."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray):
        self.whole, self.turned = whole, whole.astype(np.float64) @ turn
        d = whole.shape[1]
        self.steps = sorted({max(1, round(d * s)) for s in STEPS})
        squares = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([squares, np.zeros((len(whole), 1))], axis=1)
        self.rest = np.sqrt(rest[:, self.steps])
        self.norm = np.sqrt(rest[:, 0])
        #: Rounding of rotation, products and norms, for vectors of length 1.
        self.slack = 64 * d * np.finfo(np.float64).eps


def survivors(anchors: Turned, rows: Turned, some: slice, need: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of a tile that ``apart`` allows and whose score is ``need`` of the anchor or more."""
    a, r = anchors.turned[some], rows.turned
    before, alive, pairs, sums = 0, apart, None, None
    floor = need - anchors.slack * anchors.norm[some] * (rows.norm.max() if len(r) else 0) - 1e-6
    for k, upto in enumerate(anchors.steps):
        here = slice(before, upto)
        if pairs is None:
            part = a[:, here] @ r[:, here].T
            sums = part if sums is None else sums + part
            alive = alive & (sums + anchors.rest[some, k][:, None] * rows.rest[None, :, k] >= floor[:, None])
            if alive.sum() <= DENSE * alive.size:
                pairs = np.nonzero(alive)
                sums = sums[pairs]
        else:
            i, j = pairs
            sums = sums + np.einsum("ij,ij->i", a[i, here], r[j, here])
            good = sums + anchors.rest[some, k][i] * rows.rest[j, k] >= floor[i]
            pairs, sums = (i[good], j[good]), sums[good]
        before = upto
    i, j = np.nonzero(alive) if pairs is None else pairs
    score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", anchors.whole[some][i[k : k + 65536]], rows.whole[j[k : k + 65536]]) for k in range(0, len(i), 65536))])
    good = score >= need[i]
    return i[good] + some.start, j[good], score[good]


def best_first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores, then smaller ids; groups in order."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[rank < k]


class Best:
    """The first k (score, id) of each slot so far, and the score a row needs to enter one."""

    def __init__(self, slots: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(np.int64)
        self.slot, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.need = self.least.copy()

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        both = [np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.ids, ids))]
        keep = best_first(*both, self.k)
        self.slot, self.score, self.ids = (x[keep] for x in both)
        full = np.bincount(self.slot, minlength=len(self.need)) == self.k
        lowest = self.least.copy()
        lowest[self.slot] = self.score  # in order, so that the last of a slot stays
        self.need = np.where(full, np.maximum(lowest, self.least), self.least)


def _blocks(batches: Iterator[pa.RecordBatch], turn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Turned]]:
    for b in batches:
        for k in range(0, b.num_rows, BLOCK):
            part = b.slice(k, BLOCK)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), Turned(integers(part.column(2)), turn)


LEAST = np.iinfo(np.int64).min // 4


def _positives(rows: DataFrame, shared, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the best rows of the anchors' labels, of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, whole, turn = shared.value
        if not len(ids):
            return
        anchors = Turned(whole, turn)
        best = Best(len(ids), k, np.full(len(ids), LEAST))
        for row_ids, row_labels, block in _blocks(batches, turn):
            for at in range(0, len(ids), TILE):
                some = slice(at, min(at + TILE, len(ids)))
                same = (labels[some, None] == row_labels[None]) & (ids[some, None] != row_ids[None])
                i, j, score = survivors(anchors, block, some, best.need[some], same)
                best.add(i, score, row_ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[best.slot], best.ids, best.score)], ["anchor_id", "positive_id", "positive_score"])

    return rows.mapInArrow(run, "anchor_id long, positive_id long, positive_score long")


def _negatives(rows: DataFrame, shared, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, negative_id, negative_score): the best rows of other labels in each positive's interval, of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, whole, turn, slot_anchor, slot_id, slot_score = shared.value
        if not len(slot_anchor):
            return
        anchors = Turned(whole, turn)
        floor, top = -(-low * slot_score // 100), high * slot_score // 100
        best = Best(len(slot_anchor), k, floor)
        ends = np.searchsorted(slot_anchor, np.arange(len(ids) + 1))
        for row_ids, row_labels, block in _blocks(batches, turn):
            for at in range(0, len(ids), TILE):
                some = slice(at, min(at + TILE, len(ids)))
                need = np.full(len(ids), -LEAST)
                np.minimum.at(need, slot_anchor, np.where(floor <= top, best.need, -LEAST))
                i, j, score = survivors(anchors, block, some, need[some], labels[some, None] != row_labels[None])
                for w in range(int(np.diff(ends).max(initial=0))):
                    slot = ends[i] + w
                    has = slot < ends[i + 1]
                    slot, s, r = slot[has], score[has], j[has]
                    fits = (best.need[slot] <= s) & (s <= top[slot])
                    best.add(slot[fits], s[fits], row_ids[r[fits]])
        at = best.slot
        columns = (ids[slot_anchor[at]], slot_id[at], slot_score[at], best.ids, best.score)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return rows.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")


def _first(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """With ``rank`` from 1: the first k rows of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, part: int = ANCHORS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    ``anchors`` is a condition on the id column. Scores are inner products of floor(256 * x). An anchor's positives are the first
    rows of its label; a positive's negatives the first rows of other labels with low * positive <= 100 * negative <= high *
    positive. Higher scores come first, ties by smaller id. Rows with a null id, label or vector, with a null or non-finite
    component (or one of 2^20 or more, whose products could leave 64 bits), or of another length than most take no part; of rows that share an id
    the one with the smallest (label, vector) counts. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialize(_prepared(vectors, id_col, vector_col, label_col), "vectors")
    turn = rotation(rows)
    chosen = rows.where(anchors)
    parts = max(1, -(-chosen.count() // part))
    path = fresh_path(spark, "negatives")
    for p in range(parts):
        got = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).orderBy("vec_id").toArrow().combine_chunks()
        ids, labels = got["vec_id"].to_numpy(), got["label"].to_numpy()
        whole = integers(pa.concat_arrays(got["v"].chunks)) if len(ids) else np.zeros((0, len(turn)), np.int64)
        shared = spark.sparkContext.broadcast((ids, labels, whole, turn))
        best = _first(_positives(rows, shared, positives), ["anchor_id"], "positive_score", "positive_id", positives).drop("rank").toArrow()
        slot = np.searchsorted(ids, best["anchor_id"].to_numpy())
        order = np.argsort(slot, kind="stable")
        again = spark.sparkContext.broadcast((ids, labels, whole, turn, slot[order], best["positive_id"].to_numpy()[order], best["positive_score"].to_numpy()[order]))
        _negatives(rows, again, negatives, low, high).write.mode("append").parquet(path)
    found = spark.read.schema("anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long").parquet(path)
    first = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return first.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_rotated_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are every hundredth id of the whole embeddings table; every seventh id's label is moved by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (SELECT * FROM good WHERE vec_id % 100 = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM anchors a JOIN good b ON a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id
WHERE NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
