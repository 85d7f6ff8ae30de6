"""Operators on tokens and urls: exact round trips and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import packing, separators, tokens, urlfilter, vbyte

from .test_text_operators import EDGES, docs, prose


def plain_ids(text):
    enc = tokens.encoder(tokens.default_tokenizer()).tokenizer
    return enc.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


ROWS = [*EDGES, (1, "Hello  world\n\n  it's\tfine "), (2, " lead"), (3, "<|endoftext|> in text"), (4, "日本語 \u00a0 x"), (5, prose(5, 5000))]


def test_encoder_equals_the_library():
    r = random.Random(3)
    parts = ["a", "bc", " ", "  ", "\n", "\n\n", "\t", "!", ".", ",", "...", ' "', "'s", "é", "Ω", "\x1c", "1", "\x85", "\u00a0", "\u3000", "<|endoftext|>", "\r\n", "漢"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)] + [t for _, t in ROWS]
    enc = tokens.PieceEncoder(tokens.default_tokenizer(), limit=500)
    for k in range(0, len(texts), 100):
        ends, flat = enc.encode(pa.array(texts[k : k + 100], pa.string()))
        assert [x.tolist() for x in tokens.split_rows(ends, flat)] == [plain_ids(t) for t in texts[k : k + 100]]
    ends, flat = enc.encode(pa.array(["a b", None, "a\x1fb"]), 9)
    assert [x.tolist() for x in tokens.split_rows(ends, flat)] == [[*plain_ids(t), 9] for t in ("a b", "", "a\x1fb")]


def test_files_of_another_kind_are_not_cut(tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = tokens.PieceEncoder(path)
    assert tokens.can_be_cut(tokens.default_tokenizer()) and not enc.cut
    texts = ["Some words, here.", "", "Two  spaces\n"]
    ends, flat = enc.encode(pa.array(texts))
    assert [x.tolist() for x in tokens.split_rows(ends, flat)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_grouped_batches_keep_their_rows():
    batch = pa.RecordBatch.from_pydict({"k": [*range(50)], "t": ["x" * (k % 7) for k in range(50)]})
    for limit in (1, 40, 10_000):
        out = [*tokens.grouped(iter([batch, batch.slice(0, 0), batch]), 1, limit)]
        assert [x for b in out for x in b.column(0).to_pylist()] == [*range(50)] * 2
        assert limit > 1 or max(b.num_rows for b in out) <= 3
    assert [*tokens.grouped(iter([]), 1)] == []


def test_ranges_of_equal_keys():
    bounds = [(0, 5), (3, -2), (3, 0), (3, 9), (8, 1)]
    keys = [(k, h) for k in range(-1, 10) for h in (-5, -2, 0, 4, 9, 12)]
    got = vbyte._part_of(*(np.array([x[k] for x in keys]) for k in range(2)), *(np.array([x[k] for x in bounds]) for k in range(2)))
    assert got.tolist() == [sum(b <= x for b in bounds) for x in keys]


def test_best_fit_decreasing_equals_a_plain_search():
    r = random.Random(5)
    for window in (7, 64, 2048):
        lengths = [r.randrange(1, window + 1) for _ in range(300)]
        room, want = [], [None] * len(lengths)
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [x for x in room if x >= lengths[k]]
            least = min(fits, default=window)
            if fits:
                room.remove(least)
            room.append(least - lengths[k])
            want[k] = least
        of, offset, n = packing.best_fit_decreasing(lengths, window)
        assert [window - o for o in offset] == want and n == len(room) == len(set(of))


def test_packing_is_a_partition_of_the_ids(spark):
    table = docs(spark, ROWS)
    out = packing.pack(table, window=64)
    got = out.collect()
    by_doc, by_seq = {}, {}
    for p in got:
        assert p.length == len(p.ids) // 4 and 0 < p.length <= 64
        by_seq.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    for i, t in ROWS:
        ids = [*plain_ids(t), 1]
        pieces = sorted(by_doc[i, len(ids)], key=lambda p: p.start)
        if i != 903:  # that row is there twice
            assert b"".join(bytes(p.ids) for p in pieces) == raw(ids)
    assert len(by_doc[903, len(plain_ids("one")) + 1]) == 2
    seqs = packing.sequences(out, window=64, pad_id=9).collect()
    assert len(seqs) == len(by_seq) and all(len(s.ids) == 256 for s in seqs)
    assert packing.pack(table.limit(0)).count() == 0


def test_blocks_bound_what_is_held(spark):
    table = docs(spark, [(k, prose(k, 100)) for k in range(50)])
    few = packing.pack(table.coalesce(1), block_tokens=2000)
    assert few.select("sequence_id").distinct().count() >= packing.pack(table.coalesce(1)).select("sequence_id").distinct().count()
    assert few.agg(F.sum("length")).first()[0] == sum(len(plain_ids(prose(k, 100))) + 1 for k in range(50))


def test_variable_bytes_round_trip():
    r = np.random.default_rng(1)
    rows = [(2 ** (r.random(n) * 32)).astype(np.uint64).clip(0, 2**32 - 1).astype(np.uint32) for n in (0, 1, 3, 4, 0, 5, 1000)]
    control, data = zip(*vbyte.encode_ranks(rows), strict=True)
    assert [len(c) for c in control] == [-(-len(x) // 4) for x in rows]
    back = vbyte.decode_ranks([*control], [*data], [*map(len, rows)])
    assert all((a == b).all() for a, b in zip(rows, back, strict=True))
    for k, x in enumerate(rows):  # each row alone, too
        assert (vbyte.decode_ranks([control[k]], [data[k]], [len(x)])[0] == x).all()
    assert vbyte.encode_ranks([]) == [] and vbyte.decode_ranks([], [], []) == []


def test_ranked_files_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    vbyte.write_ids(docs(spark, ROWS), path)
    got = sorted(vbyte.read_ids(spark, path).collect(), key=lambda r: r.start)
    want = sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0])
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r, (_, t) in zip(got, want, strict=True):
        ids = raw([*plain_ids(t), 2])
        assert r.start == at and bytes(r.ids) == ids and r.n_tokens == len(ids) // 4
        at += r.n_tokens
    ranks = {r["rank"]: r["id"] for r in spark.read.parquet(f"{path}/ranks").collect()}
    counts = np.bincount(np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]))
    assert [*ranks] and all(counts[ranks[k]] >= counts[ranks[k + 1]] for k in range(len(ranks) - 1))
    vbyte.write_ids(docs(spark, ROWS).limit(0), f"{path}0")
    assert vbyte.read_ids(spark, f"{path}0").count() == 0


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    end = separators.END_ID
    flat = {"a.txt": [5, 6, end, end, 7, 8, 9, 10, 11, 12, 13, end], "b.txt": [1, 2, 3, 4], "c.txt": [], "d.txt": [end] * 7 + [3] * 200 + [end, 4]}
    for name, ids in flat.items():
        (tmp_path / name).write_bytes(np.array(ids, ">u2").tobytes())
    got = {}
    for r in separators.scan_flat(spark, f"file://{tmp_path}", block_ids=block).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.row, r.start, r.n_tokens, r.ended))
    for name, ids in flat.items():
        want, start = [], 0
        for k, x in enumerate(ids):
            if x == end:
                want.append((len(want), start, k - start, True))
                start = k + 1
        if start < len(ids):
            want.append((len(want), start, len(ids) - start, False))
        assert sorted(got.get(name, [])) == want


def test_token_counts(spark, tmp_path):
    got = separators.count_tokens(docs(spark, ROWS), f"file://{tmp_path}/flat")
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=key) == sorted(((i, len(plain_ids(t))) for i, t in ROWS), key=key)
    assert separators.count_tokens(docs(spark, ROWS).limit(0), f"file://{tmp_path}/none").count() == 0


RULES = [*urlfilter.QUERY_RULES, ("block", "blog.example.com", "/"), ("allow", "example.com", "/en/ok"), ("allow", "net", "/es/"), ("block", "org", "")]
URLS = ["http://a.com/x", "https://WWW.Example.com/en/1?q#f", "http://example.com/en/ok/1", "http://example.com/en/", "http://example.com/en", "http://x.blog.example.com/en/", "http://a.net/es/1", "http://a.net/fr/", "http://a.org", "http://a.org?x", "http://notcom/en/", "ftp://u@h.com:80/p", "no scheme", "", None, "a://b://c.com/", "http://com/", "http://.com/", "http:///en/"]


def brute_verdict(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, "allow")


@pytest.mark.parametrize("limit", [urlfilter.BROADCAST_BYTES, 0])
def test_url_rules_equal_brute_force(spark, limit):
    pages = spark.createDataFrame([*enumerate(URLS), (3, URLS[3]), (None, URLS[0])], "page_id long, url string").withColumn("host", F.lit("x"))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, RULES, broadcast_bytes=limit).collect()]
    want = [(k, *brute_verdict(u)) for k, u in [*enumerate(URLS), (3, URLS[3]), (None, URLS[0])]]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0


def test_crc_is_that_of_the_bytes(spark):
    got = spark.createDataFrame([(raw([1, 2, 70000]),)], "ids binary").select(F.crc32("ids")).first()[0]
    assert got == zlib.crc32(raw([1, 2, 70000]))


def test_flat_files_under_output_compression(spark, tmp_path):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("mapreduce.output.fileoutputformat.compress", "true")
    try:
        got = separators.count_tokens(docs(spark, ROWS), f"file://{tmp_path}/a")
        assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == sorted((str(k), len(plain_ids(t))) for k, t in ROWS)
    finally:
        hadoop.unset("mapreduce.output.fileoutputformat.compress")
    # A file that is gone is an error, not fewer rows.
    separators.write_flat(docs(spark, ROWS), f"file://{tmp_path}/b")
    gone = next((tmp_path / "b/kind=tokens").glob("*.txt"))
    keep = separators.write_flat
    gone.unlink()
    separators.write_flat = lambda *a, **k: None
    try:
        with pytest.raises(Exception, match="has no end id"):
            separators.count_tokens(docs(spark, ROWS), f"file://{tmp_path}/b").collect()
    finally:
        separators.write_flat = keep
