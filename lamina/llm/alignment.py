"""Alignment of two tokenizers over the same bytes, and how often ids meet across the corpus.

Both tokenizers encode a space and the text. Byte-owner arrays name, for each byte, the token of A and the token
of B that covers it (``np.repeat`` of token numbers by their widths): a place where either owner changes begins an
overlap, a place where both change is a cut. Cuts part the tokens into groups; every A token of a group is linked to
every B token of it.

The count of an id pair is the number of documents that hold it linked. Tasks count the distinct pairs of their
documents before anything is shuffled; the table of counts then goes to the tasks in parts of at most PART_PAIRS
pairs, however many there are, and each part looks up the pairs of all documents, written once, by binary search.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize
from .tokens import ALNUM, CUT, NOTHING, OTHER, SPACE, PieceEncoder, _byte_chars, _is_settled, default_tokenizer, grouped, short_batches

#: The sign that stands for a space in pieces of the second tokenizer.
BLANK = "▁"
#: Pieces a worker remembers for each tokenizer, and bytes of text that it aligns at once.
PIECES, BYTES = 250_000, 1 << 20
#: Links of a group from which on equal ids are put together before they are paired.
LARGE_GROUP = 1 << 16
#: Distinct pairs whose counts a task holds before it hands them on.
HELD_PAIRS = 2_000_000
#: Pairs of the table of counts that are broadcast at once (17 bytes each).
PART_PAIRS = 2_000_000


class PlainEncoder(PieceEncoder):
    """Ids of a byte-level tokenizer file; strings of special tokens are ordinary text."""

    def __init__(self, path: str, limit: int = PIECES):
        super().__init__(path, limit)
        self.tokenizer.encode_special_tokens = True


class BlankEncoder(PieceEncoder):
    """Ids of a SentencePiece model for texts that begin with a space, which the model adds itself.

    No piece of such a vocabulary has a blank after another character, a stop or comma next to a letter or digit, or a newline;
    where that is so, and normalization changes nothing, texts are cut as for the other tokenizer.
    """

    def __init__(self, path: str, limit: int = PIECES):
        import sentencepiece

        self.model, self.limit = sentencepiece.SentencePieceProcessor(model_file=path), limit
        m = self.model
        pieces = [m.id_to_piece(k) for k in range(m.get_piece_size()) if not (m.is_byte(k) or m.is_control(k) or m.is_unknown(k) or m.is_unused(k))]
        beside = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
        mixed = any(b == BLANK != a or (b in ".," and _is_settled(a)) or "\n" in (a, b) for a, b in beside)
        probe = "  a ﬁ é é\n\tb  "
        self.cut = not mixed and "\n" not in pieces and b"".join(map(token_bytes(m).__getitem__, m.encode(probe))) == f" {probe}".encode()
        self.newline = m.encode("\n")[1:]
        self._forget()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, "<u4") for x in self.model.encode([t[1:] for t in texts], num_threads=1)] if texts else []

    def _learn(self, pieces: list[str]) -> None:
        """Pieces are encoded together, a newline before each, which never merges; those that hold one, each by itself."""
        plain, others = [], []
        for p in pieces:
            (others if "\n" in p else plain).append(p)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.model.encode("\n" + "\n".join(some), num_threads=1), "<u4")[1:]
            ends = np.append(np.flatnonzero(ids == self.newline[0]), len(ids))
            self._remember(some, np.delete(ids, ends[:-1]), np.diff(ends) - 1, *self._classes(some))
        for at in range(0, len(others), 1024):
            some = others[at : at + 1024]
            each = [x[1 + len(self.newline) :] for x in self.model.encode(["\n" + p for p in some], num_threads=1)]
            self._remember(some, np.array([k for x in each for k in x], "<u4"), np.array([*map(len, each)]), *self._classes(some))

    @staticmethod
    def _classes(pieces: list[str]) -> tuple[list[int], list[int]]:
        first = [NOTHING if not p else SPACE if p[0].isspace() else ALNUM if p[0] in ".," else OTHER for p in pieces]
        last = [NOTHING if not p else SPACE if p[-1].isspace() else ALNUM if _is_settled(p[-1]) else OTHER for p in pieces]
        return first, last


def token_bytes(model) -> list[bytes]:
    """The bytes that each id of a SentencePiece model stands for; unknown and control ids stand for none."""
    out = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        none = model.is_control(k) or model.is_unknown(k)
        out.append(b"" if none else bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace(BLANK, " ").encode())
    return out


def level_bytes(tokenizer) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for; an added token stands for its own text."""
    byte_of = {c: b for b, c in _byte_chars().items() if b != ord(CUT)} | {chr(256 + 31): ord(CUT)}
    added, vocab = tokenizer.get_added_tokens_decoder(), tokenizer.get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        out[k] = token.encode() if k in added else bytes(byte_of[c] for c in token)
    return out


class Table:
    """Byte strings by id, as flat arrays."""

    def __init__(self, each: list[bytes]):
        self.width = np.array([*map(len, each)], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.width[ids]
        return self.flat[np.repeat(self.start[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]


class Digits:
    """Decimal numbers as bytes, by table."""

    def __init__(self, top: int):
        self.text = np.array([str(k) for k in range(top)], f"S{len(str(top - 1))}").view(np.uint8).reshape(top, -1)
        self.width = (self.text != 0).sum(axis=1)

    def lines(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, widths): each number followed by its end."""
        n = self.width[ids]
        out = np.concatenate([self.text[ids], np.zeros((len(ids), 1), np.uint8)], axis=1)
        out[np.arange(len(ids)), n] = ends
        return out[out != 0], n + 1


def owners(wide_a: np.ndarray, wide_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(groups of A's tokens, groups of B's, overlaps' A tokens, overlaps' B tokens) from widths in bytes over the same bytes."""
    own_a, own_b = (np.repeat(np.arange(len(w), dtype=np.int32), w) for w in (wide_a, wide_b))
    new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    cuts = np.concatenate([[0], np.cumsum(new_a & new_b, dtype=np.int32)])
    begins = np.concatenate([[0], np.flatnonzero(new_a | new_b) + 1])
    return cuts[np.cumsum(wide_a) - wide_a], cuts[np.cumsum(wide_b) - wide_b], own_a[begins], own_b[begins]


def links(a: np.ndarray, b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray, over_a: np.ndarray, over_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, A id, B id, times) of all links. A group with one token on a side is its overlaps; others pair all tokens, by distinct ids if there are many."""
    n_a, n_b = np.bincount(groups_a), np.bincount(groups_b)
    single = np.minimum(n_a, n_b) == 1
    own = groups_a[over_a]
    few = single[own]
    yield own[few], a[over_a[few]], b[over_b[few]], np.ones(int(few.sum()), np.int64)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    large = n_a * n_b > LARGE_GROUP
    some = np.flatnonzero(~(single | large)[groups_a])
    if len(some):
        g = groups_a[some]
        n = n_b[g]
        at = np.repeat(first_b[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield np.repeat(g, n), np.repeat(a[some], n), b[at], np.ones(len(at), np.int64)
    for g in np.flatnonzero(large & ~single):
        (x, k), (y, m) = (np.unique(v[f[g] : f[g] + s[g]], return_counts=True) for v, f, s in ((a, first_a, n_a), (b, first_b, n_b)))
        yield np.full(len(x) * len(y), g), np.repeat(x, len(y)), np.tile(y, len(x)), np.repeat(k, len(y)) * np.tile(m, len(x))


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first)


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as hold them all; the reader tells the width from the length."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


class Aligner:
    """Both tokenizers with the bytes of their ids; one for each worker process and pair of files."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PlainEncoder(path_a), BlankEncoder(path_b)
        bytes_a, bytes_b = level_bytes(self.a.tokenizer), token_bytes(self.b.model)
        self.bytes_a, self.bytes_b, self.base = Table(bytes_a), Table(bytes_b), len(bytes_b)
        self.digits = Digits(max(len(bytes_a), len(bytes_b)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids) of A and of B; texts that are null, empty or not what the joined tokens say have none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        edge = np.concatenate([[0], np.cumsum(size + 1)])
        raw = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[: edge[-1]]
        good, parts = size > 0, []
        for enc, table in ((self.a, self.bytes_a), (self.b, self.bytes_b)):
            at, ids = enc.encode(spaced)
            said = table.joined(ids)
            ends = np.concatenate([[0], np.cumsum(table.width[ids])])[at]
            if len(said) != len(raw) or not np.array_equal(said, raw):
                good &= np.array([np.array_equal(said[s:e], raw[x:y]) for s, e, x, y in zip(ends, ends[1:], edge, edge[1:], strict=False)], bool)
            parts.append((at, ids))
        out = []
        for at, ids in parts:
            n = np.diff(at)
            out += [np.concatenate([[0], np.cumsum(np.where(good, n, 0))]), ids[np.repeat(good, n)]]
        return tuple(out)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, *, tokenizer_a: str | None = None, tokenizer_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b): for every whole text its ids of both tokenizers with their groups, as arrays of (id, group).

    Groups are numbered from 0 within a document. A text that is null or empty, or that the joined bytes of either
    tokenizer do not give back, has empty arrays. Repeated rows stay apart, a null id stays; other columns are not read.
    """
    paths = tokenizer_a or default_tokenizer(), tokenizer_b or default_pieces()
    short_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("id", pa.int32()), ("group", pa.int32())]))

    def side(at: np.ndarray, ids: np.ndarray, groups: np.ndarray, first: np.ndarray) -> pa.Array:
        own = groups - np.repeat(first, np.diff(at))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(own, pa.int32())], ["id", "group"])).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(*paths)
        for b in grouped(batches, 1, BYTES):
            at_a, a, at_b, bb = al.encode(b.column(1))
            ga, gb, _, _ = owners(al.bytes_a.width[a], al.bytes_b.width[bb]) if len(a) else (a, bb, a, bb)
            first = np.concatenate([ga, [0]])[at_a[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), side(at_a, a, ga, first), side(at_b, bb, gb, first)], ["doc_id", "a", "b"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, a array<struct<id:int,group:int>>, b array<struct<id:int,group:int>>")


KEPT = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
NAMES = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pairs", "times", "counted"]
SCHEMA = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary, times binary, counted array<struct<pair:long,n:long>>"


def _measured(rows: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row for each document with its distinct pairs and how often each is linked; and, in rows of their own (``counted``), how
    many of a task's documents hold each pair. A pair is A's id times B's vocabulary plus B's id."""
    counted = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))

    def handed(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 1 << 16):
            x, y = keys[k : k + (1 << 16)], n[k : k + (1 << 16)]
            lists = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["pair", "n"])).cast(counted)
            blank = [pa.nulls(1, t) for t in (*[pa.int64()] * 6, pa.string(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*blank, lists], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, at_row = aligner(*paths), TaskContext.get().partitionId() << 40
        held, held_n, size = [], [], 0
        for b in grouped(batches, 1, BYTES):
            at_a, a, at_b, bb = al.encode(b.column(1))
            n = b.num_rows
            n_links, n_groups, shas = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
            pairs, times, edges = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
            if len(a):
                a, bb = a.astype(np.int64), bb.astype(np.int64)
                ga, gb, over_a, over_b = owners(al.bytes_a.width[a], al.bytes_b.width[bb])
                doc_of = np.zeros(int(ga[-1]) + 1, np.int64)
                doc_of[ga] = np.repeat(np.arange(n), np.diff(at_a))
                n_groups = np.bincount(doc_of, minlength=n)
                top = len(al.bytes_a.width) * al.base
                found = [(doc_of[g] * top + x * al.base + y, t) for g, x, y, t in links(a, bb, ga, gb, over_a, over_b)]
                whole, times = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
                edges = np.searchsorted(whole, np.arange(n + 1) * top)
                pairs = whole % top
                n_links = np.diff(np.concatenate([[0], np.cumsum(times)])[edges])
                shas = _digests(al, a, bb, ga, gb, at_a, doc_of)
                held.append(pairs)
                held_n.append(np.ones(len(pairs), np.int64))
                size += len(pairs)
                if size > 2 * HELD_PAIRS:
                    keys, counts = _summed(np.concatenate(held), np.concatenate(held_n))
                    held, held_n, size = [keys], [counts], len(keys)
                    if size > HELD_PAIRS:
                        yield from handed(keys, counts)
                        held, held_n, size = [], [], 0
            cut = [*zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            row = at_row + np.arange(n)
            at_row += n
            numbers = (np.diff(at_a), np.diff(at_b), n_groups, n_links)
            packed = [pa.array([_narrow(x[s:e]) for s, e in cut], pa.binary()) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([pa.array(row), b.column(0), *map(pa.array, numbers), pa.array(shas, pa.string()), pa.array(np.diff(edges)), *packed, pa.nulls(n, counted)], NAMES)
        if held:
            yield from handed(*_summed(np.concatenate(held), np.concatenate(held_n)))

    return rows.mapInArrow(run, SCHEMA)


def _digests(al: Aligner, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, at_a: np.ndarray, doc_of: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups as text, '' without tokens."""
    n_a, n_b = np.bincount(ga), np.bincount(gb)
    upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
    place_a, place_b = np.arange(len(a)) + (upto_b - n_b)[ga], np.arange(len(b)) + upto_a[gb]
    ids, ends = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    ends[place_a[upto_a - 1]], ends[place_b[upto_b - 1]] = ord("|"), ord(";")
    text, wide = al.digits.lines(ids, ends)
    tokens = np.bincount(doc_of, weights=n_a + n_b, minlength=len(at_a) - 1).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(tokens)])].tolist()
    view = memoryview(text)
    return [hashlib.sha256(view[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(edge, edge[1:], strict=False)]


def _looked_up(rows: DataFrame, part: DataFrame) -> DataFrame:
    """``rows`` (rid, RESULT's numbers and digest) with n_best and count_sum over the pairs of ``part`` (pair, n, best), which is broadcast."""
    got = part.toArrow()  # PART_PAIRS rows and what chance adds
    order = np.argsort(got["pair"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(tuple(got[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for b in batches:
            sizes = b.column("n_pairs").to_numpy()
            each = ([np.frombuffer(x, f"<u{len(x) // k}") for x, k in zip(b.column(c).to_pylist(), sizes.tolist(), strict=True) if k] for c in ("pairs", "times"))
            sought, many = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in each)
            sums = [np.zeros(len(sizes), np.int64)] * 2
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, sought), len(pairs) - 1)
                many[pairs[at] != sought] = 0
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(many * x[at])])[ends]) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEPT), *map(pa.array, sums)], [*KEPT, "n_best", "count_sum"])

    kept = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in KEPT)
    return rows.select(*KEPT, "n_pairs", "pairs", "times").mapInArrow(run, f"{kept}, n_best long, count_sum long")


def pair_counts(measured: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no pair of the same A id is in more."""
    counts = measured.where("counted is not null").select(F.inline("counted")).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("a", F.expr(f"pair div {base}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, *, tokenizer_a: str | None = None, tokenizer_b: str | None = None, part_pairs: int = PART_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256 (of `a1,a2|b1;a3|b2,b3`).

    n_best counts links whose pair is in as many documents as any pair of the same A id (ties too); count_sum adds up the
    pairs' counts over the links. A text that is null or empty, or that the joined bytes of either tokenizer do not give back,
    has zeros and ''. Every row is a document: repeated rows count each, a null id stays. An empty table gives no rows. Other
    columns are not read. A worker holds the distinct pairs of one document at a time beside BYTES of text.
    """
    import sentencepiece

    spark, paths = docs.sparkSession, (tokenizer_a or default_tokenizer(), tokenizer_b or default_pieces())
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = materialize(_measured(rows, paths), "aligned")
    base = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    counts = materialize(pair_counts(measured, base), "counts")
    parts = max(1, -(-counts.count() // part_pairs))
    each = measured.where("counted is null")
    found = [_looked_up(each, counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == k)) for k in range(parts)]
    out = found[0]
    if parts > 1:
        for x in found[1:]:
            out = out.union(x)
        out = out.groupBy("rid").agg(*(F.first(c).alias(c) for c in KEPT[1:]), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_byte_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers over the whole documents table."""
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
