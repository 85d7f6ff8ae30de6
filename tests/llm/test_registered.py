"""The registered queries themselves, on the smallest tables: against their SQL, or plain versions of what their digests are made from."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import entries, pii, similar

from .test_text_operators import EDGES, brute_components, brute_fingerprint, docs, prose
from .test_token_operators import plain_ids, raw

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entries.queries(), entries.oracle_sql()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    plain = lambda df: sorted(str([None if pd.isna(v) else v for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_quality_rules_base(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op2_quality_rules")}
    assert set(got) == set(texts)
    for k, t in texts.items():
        w = (t or "").encode("utf-8", "surrogatepass").split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, again = set(), 0
        for line in (t or "").split("\n"):
            if line.encode("utf-8", "surrogatepass").split():
                again += line in seen
                seen.add(line)
        base = (len(w), sum(len(x.decode("utf-8", "surrogatepass")) for x in w), sum(c in "#*$%&|<>" for c in t or ""), again, len(repeated))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)


def test_fingerprints_and_components(spark, texts):
    prints = [(k, brute_fingerprint(t)) for k, t in texts.items()]
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op3_simhash_dedup")}
    assert got == {k: (f"{f % (1 << 64):016x}", want[k]) for k, f in prints}


def test_counts_of_tokens(spark, texts):
    assert {r.doc_id: r.n_tokens for r in rows(spark, "op6_separator_scan")} == {k: len(plain_ids(t)) for k, t in texts.items()}


def test_scores(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op7_ngram_logistic")}
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_packed_pieces(spark, texts):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op8_best_fit_packing"):
        ids = [*plain_ids(texts[r.doc_id]), 1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(raw(ids[r.start : r.start + r.length]))
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for k, x in pieces.items():
        ends = np.cumsum([n for _, n in sorted(x)])
        assert [s for s, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] == len(plain_ids(texts[k])) + 1
    for x in places.values():
        ends = np.cumsum([n for _, n in sorted(x)])
        assert [s for s, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_ids_read_back(spark, texts):
    got, at = {r.doc_id: r for r in rows(spark, "op9_ranked_vbyte")}, 0
    for k in sorted(texts):
        ids = [*plain_ids(texts[k]), 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(raw(ids)))
        at += len(ids)
    assert len(got) == len(texts)


# ---- the pipeline

def test_stages_in_a_row(spark, texts):
    """Each stage keeps rows of its input; what is packed is the ids of the last texts."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = frame.columns, {r.doc_id: r.text for r in frame.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == columns, name
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        now = {r.doc_id: r.text for r in frame.collect()}
        assert len(now) == frame.count() and set(now) <= set(kept)
        if name != "personal data":
            assert all(now[k] == kept[k] for k in now)
        else:
            assert set(now) == set(kept) and all(r.n_chars == len(r.text) for r in frame.collect())
        if name == "near duplicates":
            grams = {k: similar.shingles(similar.words(t)) for k, t in now.items()}
            assert not [(a, b) for a in grams for b in grams if a < b and grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
        kept = now
    tokens = Counter()
    for r in corpus_pipeline.pack(spark, frame, SF).collect():
        tokens[r.doc_id] += r.length
    assert tokens == {k: len(plain_ids(t)) + 1 for k, t in kept.items()}


def test_run_gives_pieces_of_the_kept_documents(spark):
    spark.conf.set(corpus_pipeline.KEY, pii.TEST_KEY)
    try:
        one, two = (sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    finally:
        spark.conf.unset(corpus_pipeline.KEY)
    assert one and one == two


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    """Nulls, empty and long texts, repeats, columns with clashing names, no rows."""
    odd = docs(spark, [*EDGES, (1, prose(1, 200)), (1, prose(1, 200)), (2, prose(2, 60))])
    out = stage(spark, odd, SF)
    ids = Counter(r.doc_id for r in out.collect())
    assert set(ids) <= {None, 1, 2, 900, 901, 902, 903, 904} and 2 in ids
    assert stage(spark, odd.limit(0), SF).count() == 0
