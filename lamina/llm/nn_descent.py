"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search over it.

Equal vectors are one node, named by the smallest id; a node remembers its first few ids, so copies cost nothing.

Graph. A node starts with the best of blocks of neighbours in some random orderings (signs of projections, most significant
first; blocks are cut by number, so a crowd of near copies is cut too). Then rounds of NN-descent: each node's neighbours, and
those it is a neighbour of (a bounded number of each, new ones first), meet at the node, a join and a shuffle; there all
pairs with a new one are compared at once, and a pair closer than what either end has goes to that end. Rounds
go on until fewer than DELTA of all entries change.

Search. A query begins at its own node, or, if it is not in the table, at the nearest of some seeds. A beam holds the BEAM
nearest nodes met; each step opens all that are not open yet, through joins with the graph and the vectors, until the
beam stays as it is. The exact distances of the beam's nodes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import discard, fresh_path, materialize
from .tokens import as_binary
from .vectors import matrix, usable

#: Neighbours of a node; new and old ones each that meet in a round, from either direction; pairs that one meeting hands to an end.
DEGREE, SAMPLE, HANDED = 48, 16, 8
#: Random orderings to start from, the rows of a block, and the neighbours that a block hands to a node.
ORDERINGS, BLOCK, START = 12, 1024, 16
#: Signs of an ordering.
SIGNS = 20
#: Share of all entries below which changes end the rounds.
DELTA = 0.01
#: Nodes of a query's beam; rows that centre the projections and are seeds for queries from outside.
BEAM, SEEDS = 96, 1024
#: Rows that are worked on at once.
ROWS = 8192
CODE = "code binary"
GRAPH = "node long, code binary, ids binary, dist binary, new binary, fresh long"


# ---- vectors as 16-bit floats with a scale of their own


def encoded(x: np.ndarray) -> pa.Array:
    """A float32 scale, then each component as float16."""
    scale = np.maximum(np.abs(x).max(axis=1, initial=0), np.finfo(np.float32).tiny).astype("<f4")
    both = np.concatenate([scale.view("<f2").reshape(-1, 2), (x / scale[:, None]).astype("<f2")], axis=1)
    n, width = both.shape
    return as_binary(np.arange(n + 1) * width, both.ravel())


def decoded(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    n = len(codes)
    flat = np.frombuffer(b"".join(codes.to_pylist()), "<f2").reshape(n, -1)
    return flat[:, 2:].astype(np.float64) * np.ascontiguousarray(flat[:, :2]).view("<f4").astype(np.float64)


def _flat(column: pa.Array, kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values) of binaries; null is empty."""
    each = [x or b"" for x in column.to_pylist()]
    return np.array([len(x) // width for x in each], np.int64), np.frombuffer(b"".join(each), kind)


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column in batches of about ``rows``, none of which parts rows of one value."""
    rows = rows or ROWS
    held, n = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            whole = joined()
            key = whole.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield whole.slice(0, cut)
            held, n = [whole.slice(cut)], len(key) - cut
    if held:
        yield joined()


# ---- nodes


def nodes(vectors: DataFrame, keep: int, id_col: str, vector_col: str) -> DataFrame:
    """(node, v, ids): distinct usable vectors, by their smallest id, with their first ``keep`` ids."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = usable(rows.where("vec_id is not null"), "v").where(F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("k") <= keep)
    return first.groupBy("v").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("node", "v", "ids")


def _codes(table: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), encoded(matrix(b.column(1)))], ["node", "code"])

    return table.select("node", "v").mapInArrow(run, f"node long, {CODE}")


def _sample(codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, vectors) of at most SEEDS rows, those with the smallest hash."""
    got = codes.orderBy(F.xxhash64("node"), "node").limit(SEEDS).toArrow().combine_chunks()
    return got["node"].to_numpy(), decoded(got["code"]) if got.num_rows else np.zeros((0, 0))


# ---- the graph


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the last two axes' rows, kept from going below 0."""
    out = (x**2).sum(-1)[..., :, None] + (y**2).sum(-1)[..., None, :] - 2 * np.matmul(x, np.swapaxes(y, -1, -2))
    return np.maximum(out, 0, out=out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of BLOCK, fewer than twice that many at the end, none of which parts from another value of the first column."""
    held = None

    def cut(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        edges = np.linspace(0, rows.num_rows, max(1, rows.num_rows // BLOCK) + 1).astype(int).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            yield rows.slice(a, b - a)

    for b in batches:
        key = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
        for x, y in zip(edges, edges[1:], strict=False):
            part = b.slice(x, y - x)
            if held is not None and held.column(0)[0].as_py() != key[x]:
                yield from cut(held)
                held = None
            held = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            if (n := held.num_rows // BLOCK - 1) > 0:
                yield from cut(held.slice(0, n * BLOCK))
                held = held.slice(n * BLOCK)
    if held is not None:
        yield from cut(held)


def _start(codes: DataFrame, middle: np.ndarray) -> DataFrame:
    """(node, ids, dist): the nearest rows of each block of each ordering."""
    r = np.random.default_rng(11)
    turn = r.normal(size=(len(middle), ORDERINGS * SIGNS))
    powers = 1 << np.arange(SIGNS - 1, -1, -1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = ((decoded(b.column(1)) - middle) @ turn > 0).reshape(-1, ORDERINGS, SIGNS) @ powers
            for k in range(ORDERINGS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, k, np.int32)), pa.array(at[:, k]), *b.columns], ["k", "at", "node", "code"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: pa.RecordBatch) -> pa.RecordBatch:
            x, own = decoded(part.column(3)), part.column(2).to_numpy()
            far = _squares(x - x[0], x - x[0])
            np.fill_diagonal(far, np.inf)
            n = min(START, len(own) - 1)
            best = np.argpartition(far, n - 1, axis=1)[:, :n] if n else np.zeros((len(own), 0), np.int64)
            ends = np.arange(len(own) + 1) * n
            near = np.take_along_axis(far, best, 1)
            return pa.RecordBatch.from_arrays([part.column(2), as_binary(ends, own[best].astype("<i8").ravel()), as_binary(ends, near.astype("<f4").ravel())], ["node", "ids", "dist"])

        yield from map(block, _blocks(batches))

    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = codes.mapInArrow(place, f"k int, at long, node long, {CODE}").repartitionByRange(parts, "k", "at", "node").sortWithinPartitions("k", "at", "node")
    return placed.mapInArrow(meet, "node long, ids binary, dist binary")


def _merged(base: DataFrame, found: DataFrame, degree: int) -> DataFrame:
    """The graph with ``found`` (node, ids, dist) taken into the lists of ``base`` (node, code, ids, dist, new); fresh counts a node's changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            key = b.column(0).to_numpy()
            is_base = pc_valid(b.column(1))
            own = key[is_base]
            row = np.searchsorted(own, key)
            sizes, ids = _flat(b.column(2), "<i8", 8)
            _, dist = _flat(b.column(3), "<f4", 4)
            at, old = np.repeat(row, sizes), np.repeat(is_base, sizes)
            new = np.ones(len(ids), np.uint8)
            new[old] = _flat(b.column(4), "u1", 1)[1]
            order = np.lexsort((~old, ids, at))  # what a list already holds first
            a, i = at[order], ids[order]
            order = order[np.concatenate([[True], (a[1:] != a[:-1]) | (i[1:] != i[:-1])])] if len(order) else order
            order = order[np.lexsort((ids[order], dist[order], at[order]))]
            n = np.bincount(at[order], minlength=len(own))
            order = order[_places(n) < degree]
            ends = np.concatenate([[0], np.cumsum(np.minimum(n, degree))])
            fresh = np.bincount(at[order], weights=~old[order], minlength=len(own)).astype(np.int64)
            lists = [as_binary(ends, x[order]) for x in (ids.astype("<i8"), dist.astype("<f4"), new)]
            yield pa.RecordBatch.from_arrays([pa.array(own), b.column(1).filter(pa.array(is_base)), *lists, pa.array(fresh)], ["node", "code", "ids", "dist", "new", "fresh"])

    none = F.lit(None).cast("binary")
    rows = base.select("node", "code", "ids", "dist", "new").union(found.select("node", none, "ids", "dist", none))
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, GRAPH)


def pc_valid(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _drawn(node: np.ndarray, sizes: np.ndarray, ids: np.ndarray, new: np.ndarray, turn: int) -> np.ndarray:
    """Which list entries meet in a round: of each node the SAMPLE new and the SAMPLE old ones with the smallest hash of the round."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(node, sizes).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    kind = np.repeat(np.arange(len(node)), sizes) * 2 + new
    order = np.lexsort((z, kind))
    out = np.zeros(len(ids), bool)
    out[order] = _places(np.bincount(kind, minlength=2 * len(node))) < SAMPLE
    return out


def _met(graph: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(the graph with the entries of this round marked as old, members: host, member, new)."""

    def drawn(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        node = b.column(0).to_numpy()
        sizes, ids = _flat(b.column(2), "<i8", 8)
        new = _flat(b.column(4), "u1", 1)[1]
        return node, sizes, ids, new, _drawn(node, sizes, ids, new, turn)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, sizes, _, new, some = drawn(b)
                left = as_binary(np.concatenate([[0], np.cumsum(sizes)]), np.where(some, 0, new).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], left, b.column(5)], b.schema.names)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                node, sizes, ids, new, some = drawn(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, sizes)[some]), pa.array(ids[some]), pa.array(new[some].astype(bool))], ["host", "member", "new"])

    ahead = graph.mapInArrow(edges, "host long, member long, new boolean")
    back = ahead.select(F.col("member").alias("host"), F.col("host").alias("member"), "new")
    order = Window.partitionBy("host", "new").orderBy(F.xxhash64("member", F.lit(turn)), "member")
    back = back.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE).drop("k")
    return graph.mapInArrow(mark, GRAPH), ahead.union(back)


def _compared(graph: DataFrame, members: DataFrame) -> DataFrame:
    """(node, ids, dist): what members of a host hand to each other: at most HANDED each, nearer than the farthest that the receiver has."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sizes, dist = _flat(b.column(2), "<f4", 4)
                worst = np.full(len(sizes), np.inf, "<f4")
                ends = np.cumsum(sizes)
                full = sizes >= DEGREE
                worst[full] = dist[ends[full] - 1]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(worst)], ["member", "code", "worst"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            host, member, new = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x, worst = decoded(b.column(3)), b.column(4).to_numpy()
            sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], host[1:] != host[:-1]])), len(host)))
            starts, width, out = np.cumsum(sizes) - sizes, int(sizes.max()), []
            for k in range(0, len(sizes), 256):
                n = sizes[k : k + 256]
                place = np.minimum(starts[k : k + 256, None] + np.arange(width), len(host) - 1)
                there = np.arange(width) < n[:, None]
                far = _squares(y := x[place] - x[place[:, :1]], y)
                ids, fresh = member[place], new[place]
                fits = there[:, :, None] & there[:, None] & (fresh[:, :, None] | fresh[:, None]) & (ids[:, :, None] != ids[:, None])
                far = np.where(fits & (far < worst[place][:, :, None]), far, np.inf)
                top = min(HANDED, width)
                best = np.argpartition(far, top - 1, axis=2)[:, :, :top]
                near = np.take_along_axis(far, best, 2)
                h, i, j = np.nonzero(np.isfinite(near))
                out.append((ids[h, i], ids[h, best[h, i, j]], near[h, i, j]))
            to, ids, dist = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((dist, ids, to))
            a, i = to[order], ids[order]
            order = order[np.concatenate([[True], (a[1:] != a[:-1]) | (i[1:] != i[:-1])])] if len(order) else order
            to, first = np.unique(to[order], return_index=True)
            ends = np.append(first, len(order))
            yield pa.RecordBatch.from_arrays([pa.array(to), as_binary(ends, ids[order].astype("<i8")), as_binary(ends, dist[order].astype("<f4"))], ["node", "ids", "dist"])

    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = graph.select("node", "code", "dist").mapInArrow(last, f"member long, {CODE}, worst float")
    rows = members.join(held, "member").select("host", "member", "new", "code", "worst")
    return rows.repartition(parts, "host").sortWithinPartitions("host").mapInArrow(meet, "node long, ids binary, dist binary")


def neighbour_graph(codes: DataFrame, *, delta: float = DELTA) -> DataFrame:
    """(node, code, ids, dist, new, fresh): each node's DEGREE nearest nodes found (int64) and their squared distances (float32), nearest first."""
    _, sample = _sample(codes)
    none = F.lit(b"").cast("binary")
    base = codes.select("node", "code", none.alias("ids"), none.alias("dist"), none.alias("new"))
    if not len(sample):
        return base.withColumn("fresh", F.lit(0).cast("long"))
    graph = materialize(_merged(base, _start(codes, np.median(sample, axis=0)), DEGREE), "graph")
    total, turn = graph.count() * DEGREE, 0
    while True:
        turn += 1
        marked, members = _met(graph, turn)
        after = materialize(_merged(marked, _compared(graph, members), DEGREE), "graph")
        discard(graph)
        graph, changed = after, after.agg(F.sum("fresh")).first()[0]
        if changed <= delta * total:
            return graph


# ---- search


def _distances(rows: DataFrame) -> DataFrame:
    """(query, node, dist) of rows (query, node, qcode, code): squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = ((decoded(b.column(2)) - decoded(b.column(3))) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far)], ["query", "node", "dist"])

    return rows.select("query", "node", "qcode", "code").mapInArrow(run, "query long, node long, dist double")


def _seeded(asked: DataFrame, seeds: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(query, node): the seed nearest to each query (query, qcode)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best = _squares(decoded(b.column(1)), vectors).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seeds[best])], ["query", "node"])

    return asked.select("query", "qcode").mapInArrow(run, "query long, node long")


def search(graph: DataFrame, asked: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, node): the beam of each query of ``asked`` (query, qcode, entry: a node or null)."""
    spark = graph.sparkSession
    asked = materialize(asked, "asked")
    codes = graph.select("node", "code")
    seeds, vectors = _sample(codes)
    begun = asked.where("entry is not null").select("query", F.col("entry").alias("node"))
    if len(seeds):
        begun = begun.union(_seeded(asked.where("entry is null"), seeds, vectors))
    lists = _lists(graph)
    seen_at = fresh_path(spark, "seen")
    seen = lambda: spark.read.schema("query long, node long, dist double").parquet(seen_at)
    vectors_of = asked.select("query", "qcode")
    _distances(begun.join(codes, "node").join(vectors_of, "query")).write.parquet(seen_at)
    order = Window.partitionBy("query").orderBy("dist", "node")
    held = materialize(seen().withColumn("opened", F.lit(False)), "beam")
    while True:
        shut = held.where("not opened")
        if shut.isEmpty():
            return held.select("query", "node")
        near = shut.select("query", "node").join(lists, "node").select("query", F.explode("ids").alias("node")).distinct()
        fresh = near.join(seen().select("query", "node"), ["query", "node"], "left_anti")
        step = materialize(_distances(fresh.join(codes, "node").join(vectors_of, "query")), "step")
        both = held.withColumn("opened", F.lit(True)).union(step.withColumn("opened", F.lit(False)))
        after = materialize(both.withColumn("k", F.row_number().over(order)).where(F.col("k") <= beam).drop("k"), "beam")
        step.write.mode("append").parquet(seen_at)
        discard(held)
        discard(step)
        held = after


def _lists(graph: DataFrame) -> DataFrame:
    """(node, ids): the lists as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sizes, ids = _flat(b.column(1), "<i8", 8)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(ids))], ["node", "ids"])

    return graph.select("node", "ids").mapInArrow(run, "node long, ids array<long>")


def nearest(vectors: DataFrame, queries: DataFrame | None = None, *, k: int = 10, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows of ``vectors`` found, all if there are fewer.

    ``queries`` has the same columns and may hold rows of ``vectors`` or others (None: all of ``vectors``); a query never meets its own id.
    score is the Euclidean distance of the original vectors in double precision; nearest first, ties by smaller id. Vectors that
    are null, zero, hold a null or non-finite component, or have another length than most take no part, nor do null
    ids; rows that share an id count once, with the smallest vector. An empty table gives no rows. Other columns are not read.
    """
    table = materialize(nodes(vectors, k + 1, id_col, vector_col), "nodes")
    codes = materialize(_codes(table), "codes")
    graph = neighbour_graph(codes)
    asks = (vectors if queries is None else queries).select(F.col(id_col).cast("long").alias("query"), F.col(vector_col).alias("v"))
    width = table.select(F.size("v").alias("d")).first()
    asks = usable(asks.where("query is not null"), "v", width=width["d"] if width else 0).where(F.exists("v", lambda x: x != 0))
    asks = materialize(asks.groupBy("query").agg(F.min("v").alias("v")), "asks")
    entry = asks.join(table.select("v", F.col("node").alias("entry")), "v", "left")
    coded = _codes(asks.select(F.col("query").alias("node"), "v")).select(F.col("node").alias("query"), F.col("code").alias("qcode"))
    found = search(graph, coded.join(entry.select("query", "entry"), "query"), max(beam, k + 1))
    rows = found.join(table, "node").join(asks.withColumnRenamed("v", "q"), "query")
    far = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    rows = rows.select("query", "ids", far.alias("score")).select(F.col("query").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth row among the whole embeddings table."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
