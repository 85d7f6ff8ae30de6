"""Operators on vectors against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import hard_negatives as hn
from lamina.llm import nn_descent as nn

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank string, node string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def made(seed, n, d=12, labels=3, copies=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[: n // 3] = x[0] + 1e-3 * x[: n // 3]  # a crowd of near copies
    x[n // 3 : n // 3 + copies] = x[1]
    return [(k, x[k].tolist(), int(r.integers(labels))) for k in range(n)]


ODD = [(None, [1.0] * 12, 1), (5000, None, 1), (5001, [1.0] * 12, None), (5002, [*[1.0] * 11, None], 1), (5003, [*[1.0] * 11, math.nan], 1), (5004, [*[1.0] * 11, -math.inf], 1), (5100, [], 1), (5200, [1.0, 2.0], 1), (5300, [0.0] * 12, 0)]


def brute_negatives(rows):
    seen = {}
    for k, v, lab in rows:
        if k is not None and lab is not None and v is not None and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v):
            w = (lab, [float(np.float32(x)) for x in v])
            seen[k] = min(seen.get(k, w), w)
    ints = {k: [math.floor(256 * x) for x in v] for k, (_, v) in seen.items()}
    out = []
    for a in (k for k in seen if k % 10 == 0):
        score = {k: sum(x * y for x, y in zip(ints[a], ints[k], strict=True)) for k in seen if k != a}
        order = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in order if seen[k][0] == seen[a][0]][:5]:
            fit = [k for k in order if seen[k][0] != seen[a][0] and 30 * score[p] <= 100 * score[k] <= 90 * score[p]]
            out += [(a, p, i, k, score[p], score[k]) for i, k in enumerate(fit[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize(("part", "tile", "block"), [(hn.ANCHORS, hn.TILE, hn.BLOCK), (7, 3, 16)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, part, tile, block):
    monkeypatch.setattr(hn, "TILE", tile)
    monkeypatch.setattr(hn, "BLOCK", block)
    rows = [*made(1, 300, copies=60), *ODD, *made(2, 20)[:8]]  # the last ones share ids
    random.Random(1).shuffle(rows)
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, part=part)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_without_rows(spark):
    assert hn.hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(frame(spark, ODD[:7]), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(frame(spark, [(10, [1.0] * 12, 1)]), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_never_drop_what_is_needed():
    r = np.random.default_rng(4)
    for scale in (1, 1000, 1 << 20):
        whole = r.integers(-scale, scale + 1, (60, 9))
        turn = np.linalg.eigh((whole.T @ whole).astype(float))[1][:, ::-1]
        t = hn.Turned(whole, turn)
        exact = whole @ whole.T
        need = np.sort(exact, axis=1)[:, -7]
        i, j, s = hn.survivors(t, t, slice(0, 60), need, np.ones((60, 60), bool))
        want = [(a, b, exact[a, b]) for a in range(60) for b in range(60) if exact[a, b] >= need[a]]
        assert sorted(zip(i.tolist(), j.tolist(), s.tolist(), strict=True)) == sorted(want)


def duck(sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return con.sql(sql).fetchall()


def test_hard_negatives_equal_sql(spark):
    got = hn.op13_rotated_negatives(spark, SF).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.collect())) == sorted(duck(hn.ORACLE_SQL))


# ---- nearest neighbours


def brute_nearest(rows, asks, k=10):
    def usable(some):
        out = {}
        for i, v, _ in some:
            if i is not None and v is not None and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v) and any(v):
                w = [float(np.float32(x)) for x in v]
                out[i] = min(out.get(i, w), w)
        return out

    table, out = usable(rows), {}
    for q, v in usable(asks).items():
        far = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w, strict=True))), i) for i, w in table.items() if i != q)
        out[q] = [(r, i, d) for r, (d, i) in enumerate(far[:k], 1)]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def same(got, want):
    flat = lambda x: [(q, r, i) for q in sorted(x) for r, i, _ in x[q]]
    scores = lambda x: [d for q in sorted(x) for _, _, d in x[q]]
    return flat(got) == flat(want) and scores(got) == pytest.approx(scores(want), rel=1e-12)


def test_nearest_equals_brute_force_on_a_small_table(spark):
    rows = [*made(1, 300, copies=60), *ODD, *made(2, 20)[:8]]
    random.Random(2).shuffle(rows)
    asks = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    got = nn.nearest(frame(spark, rows), frame(spark, asks))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = found(got), brute_nearest(rows, asks)
    assert same(got, want)


def test_few_rows_none_and_queries_from_outside(spark):
    assert nn.nearest(frame(spark, [])).count() == 0
    assert nn.nearest(frame(spark, ODD[:7])).count() == 0
    assert nn.nearest(frame(spark, [(1, [1.0] * 12, 1)])).count() == 0
    rows = [(k, [float(k % 2 + 1)] * 12, 0) for k in range(6)]
    asks = [(70, [1.5] * 12, 0), (1, [2.0] * 12, 0), (71, [1.0] * 5, 0)]
    assert same(found(nn.nearest(frame(spark, rows), frame(spark, asks))), brute_nearest(rows, asks))


def test_recall_beyond_one_block_with_crowds(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("DEGREE", 24), ("SAMPLE", 10), ("ORDERINGS", 4)):
        monkeypatch.setattr(nn, name, value)
    rows = made(3, 1500, copies=300)
    asks = [r for r in rows if r[0] % 20 == 0] + [(9000 + k, v, 0) for k, v, _ in made(4, 20)]
    got, want = found(nn.nearest(frame(spark, rows), frame(spark, asks), beam=48)), brute_nearest(rows, asks)
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in got)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 9.5 * len(want)


def test_codes_keep_their_vectors():
    r = np.random.default_rng(0)
    x = r.normal(size=(50, 7)) * 10.0 ** r.integers(-20, 20, (50, 1))
    assert np.allclose(nn.decoded(nn.encoded(x)) / np.abs(x).max(axis=1, keepdims=True), x / np.abs(x).max(axis=1, keepdims=True), atol=1e-3)


def test_registered_search_finds_all_of_a_small_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    table = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    want = {}
    for k in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((table - table[k]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if j != k][:10]
        want[int(ids[k])] = [(r, int(ids[j]), float(far[j])) for r, j in enumerate(order, 1)]
    assert same(found(nn.op11_nn_descent(spark, SF)), want)
