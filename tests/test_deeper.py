"""Moments, trees of whole states, index tables, git modes: against plain versions, with nulls, ties, repeats, empty tables."""

import hashlib
import os
import random
import shutil
import subprocess
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lamina.functions import hashing, keys
from lamina.operators import history, index_tables, state, tree, walk
from lamina.plans.queries import QUERIES

T0 = datetime(2024, 1, 1)


def snapshots_frame(spark, rows):
    return spark.createDataFrame(rows, "repository_id long, snapshot_id long, created_at timestamp")


# ---- moments

@pytest.mark.parametrize("slot", ["1 day", "1 hour", "300 days"])
def test_as_of_many_equals_a_plain_search(spark, slot):
    r = random.Random(3)
    snaps = [(k % 3 if k % 9 else None, k, T0 + timedelta(minutes=r.randrange(20_000))) for k in range(80)] + [(0, 900, T0 + timedelta(hours=5)), (0, 901, T0 + timedelta(hours=5))]
    probes = [(k, r.choice([0, 1, 2, 7]), None if k % 10 == 9 else T0 + timedelta(minutes=r.randrange(-100, 21_000))) for k in range(150)] + [(500, 0, T0 + timedelta(hours=5))] * 2
    frame = spark.createDataFrame(probes, "probe long, repository_id long, moment timestamp").withColumn("created_at", F.lit("clash"))
    got = state.as_of_many(snapshots_frame(spark, snaps), frame, slot=slot)
    assert got.columns == ["probe", "repository_id", "moment", "created_at", "snapshot_id"]
    best = lambda repo, at: max(((c, s) for x, s, c in snaps if x == repo and at is not None and c <= at), default=(None, None))[1]
    assert sorted((x.probe, x.snapshot_id or -1) for x in got.collect()) == sorted((p, best(repo, at) or -1) for p, repo, at in probes)


def test_as_of_many_without_rows(spark):
    probes = spark.createDataFrame([(1, 0, T0)], "probe long, repository_id long, moment timestamp")
    assert [x.snapshot_id for x in state.as_of_many(snapshots_frame(spark, []), probes).collect()] == [None]
    assert state.as_of_many(snapshots_frame(spark, [(0, 1, T0)]), probes.limit(0)).count() == 0


# ---- trees of whole states

def plain_roots(entries, digests, repo, snapshots):
    out, files = {}, {}
    for s in snapshots:
        files |= {p: (digests[o] if st else None) for r, x, p, st, o in entries if r == repo and x == s}
        table = {p: d for p, d in files.items() if d is not None}

        def digest(folder, table=table):
            below = {p[len(folder) :] for p in table if p.startswith(folder)}
            names = sorted({(b"D" + x.split("/")[0].encode() if "/" in x else b"F" + x.encode()) for x in below})
            return hashlib.sha256(b"".join(n + b"\0" + (digest(f"{folder}{n[1:].decode()}/") if n[:1] == b"D" else table[folder + n[1:].decode()]) for n in names)).digest()

        out[s] = digest("") if table else None
    return out


def test_full_state_roots_equal_hashing_everything(spark):
    r, entries, digests = random.Random(5), [], {k: hashlib.sha256(bytes([k])).digest() for k in range(6)}
    paths = ["a", "b/c", "b/d/e", "b/d/f", "g/h/i/j", "g/k", "ü/x"]
    for repo in (0, 1):
        for s in range(1, 25):
            for p in r.sample(paths, r.randrange(0, 3)):
                gone = r.random() < 0.5
                entries.append((repo, 100 * repo + s, p, 0 if gone else 1, None if gone else r.randrange(6)))
    entries += [(0, 30, p, 0, None) for p in paths]  # nothing is left
    entries += [(0, 31, "b/c", 1, 2)]
    frame = spark.createDataFrame(entries, "repository_id long, snapshot_id long, path string, status int, object_id long").withColumn("digest", F.lit("clash")).withColumn("kind", F.lit("clash"))
    objects = spark.createDataFrame([*digests.items()], "object_id long, digest binary")
    snaps = {0: [*range(1, 25), 30, 31, 32], 1: range(101, 125)}
    rows = spark.createDataFrame([(k, s) for k, v in snaps.items() for s in v], "repository_id long, snapshot_id long")
    versions = history.directory_versions(frame, objects)
    got = {x.snapshot_id: (None if x.root is None else bytes(x.root), x.n_hashed) for x in history.state_roots(rows, versions).collect()}
    want = plain_roots(entries, digests, 0, snaps[0]) | plain_roots(entries, digests, 1, snaps[1])
    assert {s: x[0] for s, x in got.items()} == want and want[30] is None and want[31] is not None
    folders = lambda s: {p.rsplit("/", n)[0] if n <= p.count("/") else "" for _, x, p, _, _ in entries if x == s for n in range(1, p.count("/") + 2)}
    assert {s: x[1] for s, x in got.items()} == {s: len(folders(s)) for s in want}


def test_trees_of_no_entries_and_missing_objects(spark):
    frame = spark.createDataFrame([(0, 1, "a/b", 1, 9)], "repository_id long, snapshot_id long, path string, status int, object_id long")
    objects = spark.createDataFrame([], "object_id long, digest binary")
    versions = history.directory_versions(frame.limit(0), objects)
    assert versions.count() == 0
    rows = spark.createDataFrame([(0, 1)], "repository_id long, snapshot_id long")
    assert [tuple(x) for x in history.state_roots(rows, versions).collect()] == [(1, None, 0)]
    with pytest.raises(Exception, match="no object for"):
        history.directory_versions(frame, objects).count()


# ---- index tables

def test_pages_chain_and_filters_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, f"d{k % 4}/f{k:03}", k, "clash") for k in range(300)] + [(None, "x", 1, "y")], "repository_id long, path string, object_id long, sk string")
    index_tables.cached_paths(rows, f"{tmp_path}/i")
    table, pk = index_tables.read(spark, f"{tmp_path}/i"), "REPO#1"
    seen, start, n = [], None, 0
    while True:
        page, start = index_tables.page(table, pk, begins_with="CACHE#d1/", start=start, limit=6)
        assert len(page) <= 6
        seen, n = seen + [r.sk for r in page], n + 1
        if start is None:
            break
    want = sorted(f"CACHE#d{k % 4}/f{k:03}" for k in range(300) if k % 3 == 1 and k % 4 == 1)
    assert seen == want and n == -(-len(want) // 6)
    assert index_tables.page(table, "none") == ([], None)
    for token, pk_of in (("?", pk), (index_tables.token("REPO#2", "a"), pk)):
        with pytest.raises(ValueError):
            index_tables.page(table, pk_of, start=token)
    plan = keys.query(table, pk, begins_with="CACHE#d1/", after="CACHE#d1/f1")._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    for condition in ("EqualTo(pk,REPO#1)", "StringStartsWith(sk,CACHE#d1/)", "GreaterThan(sk"):
        assert condition in pushed
    assert table.where("pk is null").count() == 0 and table.count() == 300


@pytest.mark.parametrize(("parts", "limit"), [(1, 6), (7, 6), (7, 1), (7, 25), (3, 1000)])
def test_all_pages_at_once_are_those_that_chain(spark, tmp_path, parts, limit):
    rows = spark.createDataFrame([(k % 2, f"d{k % 4}/f{k:03}", k) for k in range(200)], "repository_id long, path string, object_id long")
    index_tables.write(rows, f"{tmp_path}/i", F.concat(F.lit("REPO#"), F.col("repository_id")), F.concat(F.lit("CACHE#"), F.col("path")), parts=parts)
    table = index_tables.read(spark, f"{tmp_path}/i")
    want, start, n = [], None, 0
    while n == 0 or start is not None:
        found, start = index_tables.page(table, "REPO#1", begins_with="CACHE#d3/", start=start, limit=limit)
        want, n = want + [(n, r.sk, r.object_id) for r in found], n + 1
    got = index_tables.pages(table, "REPO#1", begins_with="CACHE#d3/", limit=limit)
    assert sorted(tuple(r) for r in got.select("page", "sk", "object_id").collect()) == want and len(want) == 50
    assert got.columns == [*table.columns, "page"] and index_tables.pages(table, "none").count() == 0


def test_the_plan_of_index_pages_does_not_grow_with_the_pages(spark):
    got = QUERIES["index_pages"](spark, "/root/testdata/sf0.1")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    assert got.agg(F.max("page")).first()[0] == 10


def test_index_of_sources_leaves_own_snapshots_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, 3, 40), (1, 6, None, None), (1, 7, 3, 9)], "repository_id long, snapshot_id long, source_machine_id int, source_snapshot_id long")
    index_tables.by_source(rows, f"{tmp_path}/s")
    page, then = index_tables.page(index_tables.read(spark, f"{tmp_path}/s"), "REPO#1#SRC#3")
    assert [r.snapshot_id for r in page] == [7, 5] and then is None
    index_tables.by_snapshot(rows, f"{tmp_path}/n")
    assert [r.snapshot_id for r in index_tables.page(index_tables.read(spark, f"{tmp_path}/n"), "REPO#1", begins_with="SNAP#")[0]] == [5, 6, 7]


# ---- git modes

@pytest.mark.skipif(not shutil.which("git"), reason="git is not installed")
def test_git_trees_equal_git(spark, tmp_path):
    root, files = str(tmp_path / "w"), []
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True, text=True).stdout
    for k, name in enumerate(["run.sh", "a/plain", "a/tool", "a.b/x", "deep/er/est/f", "ü"]):
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(name)
        os.chmod(path, 0o755 if k % 2 == 0 else 0o644)
        files.append((name, os.lstat(path).st_mode, name.encode()))
    os.symlink("a/plain", f"{root}/a/link")
    files.append(("a/link", os.lstat(f"{root}/a/link").st_mode, b"a/plain"))
    run("init", "-q")
    run("add", "-A")
    want = run("write-tree").strip()
    frame = spark.createDataFrame(files, "path string, bits int, content binary")
    rows = frame.select(F.lit(0).alias("tree"), "path", tree.git_mode(F.col("bits")).alias("mode"), hashing.git_blob(F.col("content")).alias("digest"))
    nodes = tree.nodes(rows, digest=tree.git_digest)
    assert bytes(nodes.where("path = ''").first().digest).hex() == want
    said = {x.split("\t")[1]: x.replace(" -", "") for x in run("-c", "core.quotePath=false", "ls-tree", "-r", "-t", want).splitlines()}
    assert {r.path: r.line for r in walk.listing(nodes).collect()} == said
    assert walk.listing(nodes, as_json=True, summarize=True).first().line == f'{{"mode":"040000","type":"tree","digest":"{want}","path":"."}}'
