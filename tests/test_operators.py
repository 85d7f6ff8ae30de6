"""Scenarios on small tables with asserted rows, and invariants."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from lamina.functions import hashing, paths
from lamina.operators import changes, content, diff, listing, retention, state, sync, tree
from lamina.plans.queries import QUERIES
from lamina.streaming import debounce

OBS = "repository_id long, snapshot_id long, path string, status int, object_id long, mtime long"


def observations(spark, rows):
    return spark.createDataFrame([(0, s, p, int(o is not None), o, s) for s, p, o in rows], OBS)


@pytest.fixture(scope="module")
def history(spark):
    """keep never changes; data changes; gone goes and comes back; late comes late."""
    rows = [(1, "keep", 1), (1, "a/data", 2), (1, "a/gone", 3), (2, "keep", 1), (2, "a/data", 4), (2, "a/gone", None), (3, "keep", 1), (3, "a/data", 4), (3, "a/gone", None), (3, "late", 1), (4, "a/gone", 3)]
    seen = changes.classify(observations(spark, rows)).cache()
    return seen, changes.delta_entries(seen).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_classification(history):
    seen, entries = history
    got = {(r.snapshot_id, r.path): r.change for r in seen.collect()}
    assert got[1, "keep"] == "added" and got[2, "keep"] == "unchanged"
    assert got[2, "a/data"] == "modified" and got[3, "a/data"] == "unchanged"
    assert got[2, "a/gone"] == "deleted" and got[3, "a/gone"] == "noop" and got[4, "a/gone"] == "added"
    assert entries.count() == 7 and rows(changes.counters(seen).where("snapshot_id = 2"), "scanned", "added", "modified", "unchanged", "deleted") == [(2, 0, 1, 1, 1)]


def test_state_and_cache_agree(history):
    _, entries = history
    assert rows(state.as_of(entries, 2), "path", "object_id") == [("a/data", 4), ("keep", 1)]
    assert rows(state.as_of(entries, 4), "path", "object_id") == rows(state.latest(entries).where("status = 1"), "path", "object_id")
    assert rows(state.as_of_in(entries, 0, 3), "path") == rows(state.as_of(entries, 3), "path")
    assert state.as_of(entries, 99).count() == 0


@pytest.mark.parametrize("mode", ["delta", "state"])
def test_diff_is_its_own_mirror(spark, history, mode):
    _, entries = history
    objects = spark.range(1, 5).select(F.col("id").alias("object_id"), (F.col("id") * 10).alias("size"), F.lit("x").alias("digest"))
    one = rows(diff.snapshot_diff(entries, objects, 1, 3, mode=mode), "path", "change")
    back = rows(diff.snapshot_diff(entries, objects, 3, 1, mode=mode), "path", "change")
    assert back == [(p, {"A": "D", "D": "A", "M": "M"}[c]) for p, c in one]
    assert dict(one) == ({"a/data": "M", "a/gone": "D", "late": "A"} if mode == "state" else {"a/data": "D", "a/gone": "D", "keep": "D", "late": "A"})
    assert rows(diff.snapshot_diff(entries, objects, 1, 3, mode=mode, prefix="a/"), "path")[0][0].startswith("a/")
    with pytest.raises(ValueError):
        diff.snapshot_diff(entries, objects, 1, 3, mode="both")


def test_move_classes_and_guard(history):
    _, entries = history
    got = {r.object_id: r["class"] for r in diff.move_classes(diff.by_object(entries, 1, 3)).collect()}
    assert got == {1: "moved", 2: "deleted", 3: "deleted", 4: "added"}
    cache = state.latest(entries)
    assert diff.cross_repository(cache, 0, 1, limit=10).count() > 0
    with pytest.raises(Exception, match="more than 1 rows"):
        diff.cross_repository(cache, 0, 1, limit=1).collect()


def test_references(spark):
    snaps = spark.createDataFrame([(k, 0, f"2024-01-0{k} 10:00:00") for k in range(1, 5)], "snapshot_id long, repository_id long, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    of = lambda ref: [r.snapshot_id for r in state.resolve(snaps, ref).collect()]
    assert of("@latest") == [4] and of("@latest~2") == [2] and of("@latest~9") == []
    assert of("@2024-01-02") == [2] and of("@2024-01-02T09:59") == [1] and of("@2023-01-01") == [] and of("3") == [3]
    with pytest.raises(ValueError):
        state.parse_ref("@yesterday")
    assert state.after(snaps, 2).count() == 2 and state.after(snaps, 77).count() == 4
    assert rows(state.with_parents(snaps), "snapshot_id", "parent_id") == [(1, None), (2, 1), (3, 2), (4, 3)]


def test_scan_against_cache(spark):
    cache = spark.createDataFrame([("same", 1, 10, 5, 100), ("touched", 1, 10, 5, 101), ("changed", 1, 10, 5, 102), ("gone", 1, 10, 5, 103), ("back", 0, None, None, None)], "path string, status int, size long, mtime long, fast_digest long")
    walked = spark.createDataFrame([("same", 10, 5, 100), ("touched", 10, 9, 101), ("changed", 11, 9, 999), ("back", 1, 1, 1), ("new", 1, 1, 1)], "path string, size long, mtime long, fast_digest long")
    cache = cache.select("path", "status", "size", "fast_digest", F.when(F.col("path") == "touched", 5).otherwise(F.col("mtime")).alias("mtime"))
    walked = walked.select("path", "size", "mtime", "fast_digest")
    got = {r.path: (r.change, r.refresh_mtime) for r in changes.scan_against_cache(walked, cache).collect()}
    assert got["touched"] == ("unchanged", True) and got["changed"][0] == "modified" and got["gone"][0] == "deleted" and got["back"][0] == got["new"][0] == "added"


def test_listing(spark, history):
    cache = state.latest(history[1])
    assert rows(listing.files(cache, 0, "a/"), "path") == [("a/data",), ("a/gone",)]
    assert rows(listing.children(cache, 0, ""), "path") == [("keep",), ("late",)] and rows(listing.children(cache, 0, "/a/"), "path") == [("a/data",), ("a/gone",)]
    assert rows(listing.subdirectories(cache, 0, ""), "name", "n_files") == [("a", 2)]
    page = listing.page(listing.files(cache, 0), page=2, per_page=3).collect()
    assert [r.path for r in page] == ["late"] and page[0].total == 4 and page[0].pages == 2


def test_gc(spark, history):
    _, entries = history
    snaps = spark.createDataFrame([(k, 0, k) for k in range(1, 5)], "snapshot_id long, repository_id long, created_at long")
    objects = spark.range(1, 7).select(F.col("id").alias("object_id"), F.lit(1).alias("size"), F.lit("x").alias("digest"))
    assert retention.prune_set(snaps, older_than=F.lit(9)).count() == 0  # an age alone prunes nothing
    assert retention.prune_set(snaps, older_than=F.lit(3), days_alone=True).count() == 2
    pruned = retention.prune_set(snaps, keep_last=2)
    assert rows(pruned, "snapshot_id") == [(1,), (2,)]
    assert rows(retention.orphans_dry_run(entries, objects, pruned), "object_id") == [(2,), (4,), (5,), (6,)]
    roots = spark.createDataFrame([(3, 5), (1, 6)], "snapshot_id long, object_id long")
    assert rows(retention.orphans_live(entries, objects, pruned, roots), "object_id") == [(2,), (4,), (6,)]
    cache = state.latest(entries)
    assert rows(retention.cache_after(cache, pruned), "path") == [("a/gone",), ("late",)]
    assert retention.cache_after(cache, pruned, protect_live=True).count() == 4
    replicas = spark.createDataFrame([(2, 1), (4, 1), (4, 2)], "object_id long, store_id long")
    tags = spark.createDataFrame([(2, "k")], "object_id long, key string")
    got = retention.replica_actions(objects.where("object_id in (2, 4, 6)"), replicas, tags, store_ids=[1])
    assert rows(got, "object_id", "n_replicas", "n_in_scope", "removable", "tagged") == [(2, 1, 1, True, True), (4, 2, 1, False, False), (6, 0, 0, True, False)]


def test_plans_on_content(spark, history):
    cache = state.latest(history[1])
    replicas = spark.createDataFrame([(1, 1, "p1", False), (3, 1, "p3", True)], "object_id long, store_id long, path string, encrypted boolean")
    stores = spark.createDataFrame([(1, "s", "u"), (2, "t", "u")], "store_id long, name string, url string")
    push = {r.path: r.action for r in content.push_plan(cache, replicas, 0, 2).collect()}
    assert push == {"keep": "push", "late": "skip", "a/data": "push", "a/gone": "push"}
    restore = {r.path: (r.candidates, r.store) for r in content.restore_plan(cache.where("status = 1"), replicas, stores).collect()}
    assert restore == {"keep": (1, "s"), "late": (1, "s"), "a/data": (0, None), "a/gone": (0, None)}
    objects = spark.createDataFrame([(1, "d1", 5)], "object_id long, digest string, size long")
    fresh = spark.createDataFrame([("d1", 5), ("d3", 7), ("d2", 6), ("d2", 6)], "digest string, size long")
    assert rows(content.get_or_create(objects, fresh, 10), "object_id", "digest") == [(1, "d1"), (10, "d2"), (11, "d3")]


def leaf(text):
    return hashlib.sha256(text.encode()).digest()


def brute_root(files):
    names = {}
    for path, digest in files.items():
        head, _, rest = path.partition("/")
        names.setdefault(head, {})[rest] = digest
    parts = [b"D" + n.encode() + b"\0" + brute_root(x) if "" not in x else b"F" + n.encode() + b"\0" + x[""] for n, x in names.items()]
    return hashlib.sha256(b"".join(sorted(parts))).digest()


def test_merkle_trees(spark):
    files = {"z": leaf("1"), "a/b/c": leaf("2"), "a/é": leaf("3"), "a/b/d": leaf("4"), "Z/q": leaf("5")}
    table = spark.createDataFrame([(1, p, d) for p, d in files.items()], "tree int, path string, digest binary")
    root = tree.roots(table).first()
    assert bytes(root.digest) == brute_root(files) and (root.n_files, root.n_dirs) == (5, 3)
    assert tree.roots(table.orderBy(F.desc("path")).repartition(3)).first() == root
    other = table.withColumn("tree", F.lit(2)).where("path <> 'z'").withColumn("digest", F.when(F.col("path") == "a/b/c", F.lit(leaf("x"))).otherwise(F.col("digest")))
    nodes = tree.nodes(table.union(other))
    got = rows(tree.diff(nodes.where("tree = 1"), nodes.where("tree = 2"), 2), "path", "change")
    assert got == [("", "M"), ("a", "M"), ("a/b", "M"), ("a/b/c", "M"), ("z", "D")]
    assert tree.nodes(table.limit(0)).count() == 0


def test_git_objects(spark):
    blob = spark.createDataFrame([(b"hello\n",)], "b binary").select(F.hex(hashing.git_blob(F.col("b")))).first()[0].lower()
    assert blob == "ce013625030ba8dba906f756967f9e9ca394464a"
    body = b"100644 hello.txt\0" + bytes.fromhex(blob)
    want = hashlib.sha1(b"tree %d\0" % len(body) + body).digest()
    table = spark.createDataFrame([(1, "hello.txt", bytes.fromhex(blob))], "tree int, path string, digest binary")
    assert bytes(tree.roots(table, digest=tree.git_digest).first().digest) == want


def test_hashes(spark):
    import xxhash

    one = spark.createDataFrame([(b"abc",), (None,)], "b binary").select(hashing.xxh64(F.col("b")).alias("x"), hashing.xxh3(F.col("b")).alias("y"), hashing.blake3(F.col("b")).alias("z")).collect()
    assert one[0].x & 2**64 - 1 == xxhash.xxh64_intdigest(b"abc") and one[0].y & 2**64 - 1 == xxhash.xxh3_64_intdigest(b"abc") and one[1].x is None
    assert hashing.blake3_digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert bytes(one[0].z).hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    long = bytes(k % 251 for k in range(2049))
    assert hashing.blake3_digest(long).hex()[:16] == "5f4d72f40d7a5f82"


def test_blake3_of_all_documents(spark):
    """Digests of many values at once equal those by the published recursion."""
    def compress(chain, block, length, counter, flags):
        m, mask = list(struct.unpack("<16I", block.ljust(64, b"\0"))), 2**32 - 1
        v = [*chain, *hashing._IV[:4], counter & mask, counter >> 32, length, flags]
        turn = lambda x, r: (x >> r | x << 32 - r) & mask
        for _ in range(7):
            for k, (a, b, c, d) in enumerate(hashing._QUARTERS):
                for x, p, q in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                    v[a] = (v[a] + v[b] + x) & mask
                    v[d] = turn(v[d] ^ v[a], p)
                    v[c] = (v[c] + v[d]) & mask
                    v[b] = turn(v[b] ^ v[c], q)
            m = [m[k] for k in hashing._ORDER]
        return [v[k] ^ v[k + 8] for k in range(8)]

    def node(data, counter, root):
        if len(data) <= 1024:
            chain, blocks = hashing._IV, [data[k : k + 64] for k in range(0, len(data), 64)] or [b""]
            for k, block in enumerate(blocks):
                last = k == len(blocks) - 1
                chain = compress(chain, block, len(block), counter, (k == 0) * 1 | last * (2 | root))
            return chain
        left = 1 << (-(-len(data) // 1024) - 1).bit_length() - 1
        halves = [*node(data[: 1024 * left], counter, 0), *node(data[1024 * left :], counter + left, 0)]
        return compress(hashing._IV, struct.pack("<16I", *halves), 64, 0, 4 | root)

    want = lambda b: struct.pack("<8I", *node(b, 0, 8))
    values = [bytes(k % 251 for k in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 5000, 7169, 31745, 40)]
    assert hashing.blake3_digests(values) == [want(v) for v in values] and hashing.blake3_digests([]) == []
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r.digest for r in QUERIES["digest_blake3"](spark, folder).collect()}
    assert got.keys() == texts.keys() and all(got[k] == want(texts[k].encode()).hex() for k in sorted(texts)[:20])


def test_path_functions(spark):
    table = spark.createDataFrame([("a/b/c.txt",), ("top",), ("",)], "p string")
    p = F.col("p")
    got = table.select(paths.depth(p), paths.basename(p), paths.parent(p), paths.ancestors(p), paths.as_prefix(p)).collect()
    assert [tuple(r) for r in got] == [(2, "c.txt", "a/b", ["a", "a/b"], "a/b/c.txt/"), (0, "top", "", [], "top/"), (0, "", "", [], "")]
    hexes = spark.createDataFrame([("ab",), ("abc",), ("abcd",)], "h string")
    assert [r[0] for r in hexes.select(paths.blob_path(F.col("h"))).collect()] == ["objects/ab", "objects/abc", "objects/ab/cd/abcd"]
    sizes = spark.createDataFrame([(999,), (1000,), (1_500_000,), (2_000_000_000,)], "s long")
    assert [r[0] for r in sizes.select(paths.human_size(F.col("s"))).collect()] == ["999B", "1.0K", "1.5M", "2.0G"]
    modes = spark.createDataFrame([(0o040000,), (0o120777,), (0o100755,), (0o100644,)], "m int")
    assert [r[0] for r in modes.select(paths.file_kind(F.col("m"))).collect()] == ["directory", "symlink", "executable", "regular"]


def test_json_and_tags(spark):
    table = spark.createDataFrame([('{"a":"1"}',), (None,)], "c string")
    c = F.col("c")
    assert [r[0] for r in table.select(content.json_get(c, "a", "none")).collect()] == ["1", "none"]
    assert [r[0] for r in table.select(content.json_set(c, "b", F.lit("2"))).collect()] == ['{"a":"1","b":"2"}', '{"b":"2"}']
    assert [r[0] for r in table.select(content.json_set(c, "a", F.lit(None).cast("string"))).collect()] == ["{}", "{}"]
    tags = spark.createDataFrame([(1, "k", "x"), (1, "l", None)], "object_id long, key string, value string")
    new = spark.createDataFrame([(1, "k", None), (2, "k", "y")], "object_id long, key string, value string")
    assert {tuple(r) for r in content.tags_upsert(tags, new).collect()} == {(1, "k", None), (1, "l", None), (2, "k", "y")}


def test_sync(spark, history):
    _, entries = history
    early, late = entries.where("snapshot_id <= 2"), entries.where("snapshot_id > 2")
    assert rows(sync.merge_cache(state.latest(early), late), "path", "object_id", "status") == rows(state.latest(entries), "path", "object_id", "status")
    seen = spark.createDataFrame([(1, 5)], "source_machine_id int, source_snapshot_id long")
    more = spark.createDataFrame([(1, 5), (2, 5), (1, 6)], "source_machine_id int, source_snapshot_id long")
    assert sync.new_arrivals(more, seen).count() == 2
    bare = spark.createDataFrame([(1, None, 1), (1, "d", None), (1, "d", 2), (0, None, None)], "status int, digest string, size long")
    assert sync.acceptable(bare).count() == 2


def brute_sessions(times, quiet, most):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] < quiet and t - out[-1][0] < most:
            out[-1][1:] = [t, out[-1][2] + 1]
        else:
            out.append([t, t, 1])
    return [tuple(x) for x in out]


def test_debounce(spark):
    import random

    r = random.Random(1)
    times = {k: [r.randrange(3000) for _ in range(n)] for k, n in (("a", 1), ("b", 60), ("c", 400), ("d", 2))} | {"e": [0, 60, 119, 120, 179, 1000]}
    table = spark.createDataFrame([(k, t) for k, x in times.items() for t in x] + [("f", None)], "k string, t long")
    got = {}
    for x in debounce.sessions(table, key="k", time="t", quiet=60, max_delay=100).collect():
        got.setdefault(x.k, []).append((x["first"], x["last"], x.n_events))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_sessions(v, 60, 100) for k, v in times.items()}


def test_golden_tree(spark):
    from lamina.plans.queries import QUERIES

    root = QUERIES["tree_root_native"](spark, "/root/testdata/sf0.01").first().digest
    assert root == "07359d29ca8d9afad40c923611ade4fdf2daf80e1950b85ac9d44e19618e7467"
