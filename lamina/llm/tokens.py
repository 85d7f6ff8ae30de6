"""Tokenization of whole texts with a public tokenizer file, at the speed of a dictionary.

A byte-level BPE never merges across the boundaries that its pattern sets: before a space or newline that
follows another character, between a letter or digit and a full stop or comma, and after a newline alone.
Arrow cuts the texts of a batch there and numbers the distinct pieces; each worker keeps a bounded
dictionary from piece to ids and asks the tokenizers library only for pieces it has not seen. Where a
cut is no boundary (white space that runs on, stops after other signs) the pieces are joined again. Files of
any other kind are not cut: whole texts go to the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces a worker remembers before it starts anew, and their characters; bounds its memory to about 250 MB.
CACHE_PIECES, CACHE_CHARS = 1_000_000, 16_000_000
#: Rows in an Arrow batch; whole texts may be long, so batches are short.
BATCH_ROWS = 256
#: Bytes of text that are encoded at once, but for a single longer one: the more, the fewer pieces are looked up.
GROUP_BYTES = 4 << 20
#: Where Arrow cuts; a text with this character in it is not cut.
CUT = "\x1f"
#: What a piece ends with: a letter or digit, white space, anything else, nothing; what it begins with: white space, a stop, anything else, nothing.
ALNUM, SPACE, OTHER, NOTHING = range(4)
#: Letters up to here are assigned for good, so every library's tables agree on them.
SETTLED = "\u0800"


def short_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: texts are long, the default of 10,000 rows is too many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary; CUT becomes a space."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)} | {ord(CUT): " "}


def _is_settled(c: str) -> bool:
    return c.isalnum() if c.isascii() else c.isalpha() and c < SETTLED


def _is_word(piece: str) -> bool:
    """Letters only, after a space or none, that all tables call letters: one word of the file's pattern."""
    bare = piece[1:] if piece[:1] == " " else piece
    return bare.isalpha() and (bare.isascii() or max(bare) < SETTLED)


def can_be_cut(path: str) -> bool:
    """Whether a tokenizer file is a byte-level BPE whose ids don't depend on what lies beyond a boundary."""
    with open(path) as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    added = spec.get("added_tokens") or []
    apart = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or {*t["content"]} & {*" \n.,"} for t in added)
    return bool(spec.get("normalizer") is None and model.get("type") == "BPE" and plain and byte_level and apart)


class PieceEncoder:
    """Encodes texts to uint32 ids; equal to ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.limit, self.cut = Tokenizer.from_file(path), limit, can_be_cut(path)
        if self.cut:
            # The same model over words that already are in the vocabulary's characters, a space between two.
            model = self.tokenizer.model
            getattr(model, "_resize_cache", lambda n: None)(0)  # its own dictionary of words only costs time beside this one
            self.words = Tokenizer(model)
            self.words.pre_tokenizer = WhitespaceSplit()
            self.chars = _byte_chars()
            added = self.tokenizer.get_added_tokens_decoder()
            self.width = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
            for token, k in self.tokenizer.get_vocab().items():  # a token has one character for each byte, an added one is its own text
                self.width[k] = len(token.encode() if k in added else token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.n, self.used, self.held = 0, 0, 0
        self.ids, self.start, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.first, self.last = np.zeros(1 << 14, np.int8), np.zeros(1 << 14, np.int8)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray, first: np.ndarray | list[int], last: list[int] | int) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(pieces) > len(self.start):
            for name in ("start", "size", "first", "last"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        a, b = self.n, self.n + len(pieces)
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[a:b], self.start[a:b] = sizes, self.used + np.cumsum(sizes) - sizes
        self.first[a:b], self.last[a:b] = first, last
        self.known.update(zip(pieces, range(a, b), strict=True))
        self.n, self.used, self.held = b, self.used + len(ids), self.held + sum(map(len, pieces))

    def _learn(self, pieces: list[str]) -> None:
        """Words of settled letters are encoded together and parted by the bytes that their tokens cover, others each."""
        words, others = [], []
        for p in pieces:
            (words if _is_word(p) else others).append(p)
        for at in range(0, len(words), 16_384):
            some = words[at : at + 16_384]
            raw = CUT.join(some).encode()
            ids = np.array(self.words.encode_batch_fast([raw.decode("latin-1").translate(self.chars)], add_special_tokens=False)[0].ids, "<u4")
            seen = np.frombuffer(raw, np.uint8)
            ends = np.append(np.flatnonzero(seen == ord(CUT)), len(raw))
            first = np.where(seen[np.concatenate([[0], ends[:-1] + 1])] == ord(" "), SPACE, OTHER)
            tokens = np.searchsorted(np.cumsum(self.width[ids]), ends - np.arange(len(some))) + 1
            self._remember(some, ids, np.diff(tokens, prepend=0), first, ALNUM)
        for at in range(0, len(others), 1024):
            some = others[at : at + 1024]
            ids = self._ids(some)
            first = [NOTHING if not p else SPACE if p[0].isspace() else ALNUM if p[0] in ".," else OTHER for p in some]
            last = [NOTHING if not p else SPACE if p[-1].isspace() else ALNUM if _is_settled(p[-1]) else OTHER for p in some]
            self._remember(some, np.concatenate(ids), np.array([*map(len, ids)]), first, last)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        found = [*map(self.known.get, pieces)]
        if None in found:
            self._learn([*dict.fromkeys(p for p, k in zip(pieces, found, strict=True) if k is None)])
            found = [self.known[p] if k is None else k for p, k in zip(pieces, found, strict=True)]
        return np.array(found, np.int64)

    def encode(self, texts: pa.Array, tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): those of text k, and ``tail`` unless None, lie from offsets[k] to offsets[k + 1]. Null texts are empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.cut or pc.any(pc.match_substring(texts, CUT)).as_py():
            each = self._ids(texts.to_pylist())
            counts, flat = np.array([len(x) for x in each], np.int64), np.concatenate([np.zeros(0, "<u4"), *each])
        else:
            counts, flat = self._by_pieces(texts)
        if tail is not None:
            ends = np.cumsum(counts + 1) - 1
            own = np.ones(len(flat) + len(counts), bool)
            own[ends] = False
            out = np.full(len(own), tail, "<u4")
            out[own] = flat
            counts, flat = counts + 1, out
        return np.concatenate([[0], np.cumsum(counts)]), flat

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.limit or self.held > CACHE_CHARS:
            self._forget()
        for sign, put in ((" ", CUT + " "), ("\n", CUT + "\n" + CUT), (".", CUT + "."), (",", CUT + ",")):
            texts = pc.replace_substring(texts, sign, put)
        lists = pc.split_pattern(texts, CUT)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = self._numbers(pieces)[coded.indices.to_numpy(zero_copy_only=False)]
        begin = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        number = self._rejoined(number, begin, pieces, coded.indices)
        size = self.size[number]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.start[number] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return (np.add.reduceat(size, begin) if len(begin) else np.zeros(0, np.int64)), flat

    def _rejoined(self, number: np.ndarray, begin: np.ndarray, pieces: list[str], codes: pa.Array) -> np.ndarray:
        """The numbers of the pieces, runs without a boundary between them as one piece, in the place of their first."""
        last, first = self.last[number[:-1]], self.first[number[1:]]
        joined = (last == NOTHING) | (first == NOTHING) | ((first == SPACE) & (last == SPACE)) | ((first == ALNUM) & (last != ALNUM))
        within = np.ones(len(number), bool)
        within[begin] = False
        joined &= within[1:]
        # White space that runs on belongs to what follows: how it is parted depends on it.
        joined[1:] |= joined[:-1] & (last[1:] == SPACE) & within[2:]
        if not joined.any():
            return number
        edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2] + 1  # pieces from start to end, excluded
        touched = [codes[a:b].to_pylist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        whole = self._numbers(["".join(map(pieces.__getitem__, x)) for x in touched])
        out, empty = number.copy(), self._numbers([""])[0]
        inside = np.concatenate([[False], joined])
        out[inside] = empty
        out[starts] = whole
        return out


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, pieces: int = CACHE_PIECES) -> PieceEncoder:
    """One encoder per worker process, file and size of its dictionary, kept across tasks."""
    if (path, pieces) not in _encoders:
        _encoders[path, pieces] = PieceEncoder(path, pieces)
    return _encoders[path, pieces]


def grouped(batches: Iterator[pa.RecordBatch], column: int, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of one column: short ones together, large ones in halves."""

    def halves(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if b.num_rows > 1 and b.column(column).nbytes > 2 * limit:
            half = b.num_rows // 2
            yield from halves(b.slice(0, half))
            yield from halves(b.slice(half))
        else:
            yield b

    held, size = [], 0
    for b in (x for big in batches for x in halves(big)):
        held.append(b)
        size += b.column(column).nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def as_binary(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """Rows of a flat array as binaries, without a copy for each row."""
    at = pa.py_buffer((offsets * values.itemsize).astype("<i4" if values.nbytes < 1 << 31 else "<i8"))
    kind = pa.binary() if values.nbytes < 1 << 31 else pa.large_binary()
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(values))])


def split_rows(offsets: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in pairwise(offsets.tolist())]


def tokenized(docs: DataFrame, *, tokenizer: str | None = None, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of every whole text as little-endian uint32, then ``end_id`` unless None.

    Nulls: a null text is empty, a null id stays. Repeated rows stay apart. Other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in grouped(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), as_binary(*enc.encode(b.column(1), end_id))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")
