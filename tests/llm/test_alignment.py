"""Two tokenizers over the same bytes, against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import alignment as al

from .test_text_operators import EDGES, docs, prose

FILES = al.default_tokenizer(), al.default_pieces()


def plain(rows):
    """(doc_id -> result tuple) by the definition, tokens by the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    bytes_a, bytes_b = al.level_bytes(a), al.token_bytes(b)
    seen, counts = [], Counter()
    for k, t in rows:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        said = [[v[x] for x in i] for v, i in zip((bytes_a, bytes_b), ids, strict=True)]
        if any(b"".join(x) != (" " + (t or "")).encode() for x in said):
            ids = ([], [])
        ends = [np.cumsum([len(x) for x in s]).tolist() if i else [] for s, i in zip(said, ids, strict=True)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for c in cuts:
            to = [e.index(c) + 1 for e in ends]
            groups.append([i[x:y] for i, x, y in zip(ids, at, to, strict=True)])
            at = to
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        text = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        seen.append((k, *map(len, ids), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(((k, na, nb, g, len(ls), sum(counts[x] == best[x[0]] for x in ls), sum(counts[x] for x in ls), h) for k, na, nb, g, ls, h in seen), key=str)


def noisy(seed, n):
    r = random.Random(seed)
    parts = ["the", "Etc.", " ", "  ", "\n", "\t", "...", ",", ".b", "日本語", "é", "é", "ﬁ", " ", "😀", "don't", "12,345.6", "----", "#" * 9, "<s>", "<|endoftext|>", "<0x41>", "\x00", "xqzj" * 3, "    ", "\r\n", "A.B"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(1, 25))) for _ in range(n)]


ROWS = [*EDGES, *enumerate(noisy(1, 150), 100), (400, "a ▁ b"), (401, "a\x1fb c"), (402, prose(5, 3000)), (403, "=" * 3001 + "日" * 700), (404, prose(5, 3000)), (404, "again"), (404, "again"), (None, "no id")]


def test_pieces_give_the_ids_of_whole_texts():
    enc = al.BlankEncoder(FILES[1], limit=400)
    assert enc.cut
    texts = [" " + t for t in [*noisy(2, 2500), " ", "  x", "\n", "a\n\n b ."]]
    for k in range(0, len(texts), 300):
        some = texts[k : k + 300]
        at, ids = enc.encode(pa.array(some))
        assert [ids[s:e].tolist() for s, e in zip(at, at[1:], strict=False)] == enc.model.encode([t[1:] for t in some])


@pytest.mark.parametrize("large", [al.LARGE_GROUP, 4])
def test_links_equal_all_pairs_of_a_group(monkeypatch, large):
    monkeypatch.setattr(al, "LARGE_GROUP", large)
    r = np.random.default_rng(3)
    for _ in range(200):
        total = int(r.integers(1, 30))
        wide = []
        for _ in range(2):
            ends = np.unique(np.append(r.integers(1, total + 1, r.integers(1, 12)), total))
            wide.append(np.diff(ends, prepend=0))
        a, b = (r.integers(0, 4, len(w)) for w in wide)
        ga, gb, oa, ob = al.owners(*wide)
        ends_a, ends_b = np.cumsum(wide[0]), np.cumsum(wide[1])
        cuts = sorted(set(ends_a) & set(ends_b))
        assert ga.tolist() == np.searchsorted(cuts, ends_a).tolist() and gb.tolist() == np.searchsorted(cuts, ends_b).tolist()
        meet = [(i, j) for i in range(len(a)) for j in range(len(b)) if min(ends_a[i], ends_b[j]) > max(ends_a[i] - wide[0][i], ends_b[j] - wide[1][j])]
        assert sorted(zip(oa.tolist(), ob.tolist(), strict=True)) == meet
        got = Counter()
        for g, x, y, t in al.links(a, b, ga, gb, oa, ob):
            for row in zip(g.tolist(), x.tolist(), y.tolist(), t.tolist(), strict=True):
                got[row[:3]] += row[3]
        assert got == Counter((int(ga[i]), int(a[i]), int(b[j])) for i in range(len(a)) for j in range(len(b)) if ga[i] == gb[j])


@pytest.mark.parametrize("part_pairs", [al.PART_PAIRS, 300])
def test_alignment_equals_brute_force(spark, part_pairs, monkeypatch):
    frame = docs(spark, ROWS).withColumn("n_links", F.lit("clash")).withColumn("pair", F.lit(1))
    got = al.alignment(frame.repartition(3), part_pairs=part_pairs)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(ROWS)


def test_empty_table_and_texts_without_tokens(spark):
    assert al.alignment(docs(spark, [])).count() == 0
    assert {tuple(r) for r in al.alignment(docs(spark, [(1, None), (2, "")])).collect()} == {(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)}


def test_groups_of_tokens(spark):
    rows = {r.doc_id: r for r in al.aligned(docs(spark, [(1, "whatever, it is"), (2, None), (3, "x")])).collect()}
    assert rows[2].a == rows[2].b == []
    import sentencepiece

    assert [x.id for x in rows[1].b] == sentencepiece.SentencePieceProcessor(model_file=FILES[1]).encode("whatever, it is")
    assert [x.group for x in rows[1].a][0] == 0 and {x.group for x in rows[1].a} == {x.group for x in rows[1].b}
    assert [x.group for x in rows[3].a] == [0]


def test_registered_query(spark):
    got = al.op12_byte_owners(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.collect()), key=str) == plain([tuple(r) for r in rows])
