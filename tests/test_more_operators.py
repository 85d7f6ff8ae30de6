"""Sizes, times, walks, trees over short hashes, debounce of hot keys and whole exchanges, against plain versions."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lamina.functions import keys, paths
from lamina.operators import content, diff, exchange, listing, state, summary, tree, walk
from lamina.streaming import debounce


def test_human_sizes_round_the_binary_quotient(spark):
    r = random.Random(1)
    sizes = [*range(0, 3000, 7), *range(1050, 2000, 50), *(10**6 + 50_000 * k for k in range(200)), 10**12, 123_456_789_012_345, *(r.randrange(10 ** r.randrange(1, 16)) for _ in range(500))]
    sizes += [1000 * k + 50 * j for k in range(1, 1000, 13) for j in range(20)]

    def shown(n):
        for unit, name in ((10**9, "G"), (10**6, "M"), (1000, "K")):
            if n >= unit:
                return f"{n / unit:.1f}{name}"
        return f"{n}B"

    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", paths.human_size(F.col("n")).alias("s"))
    assert [(x.n, x.s) for x in rows.collect() if x.s != shown(x.n)] == []


def test_times_are_utc_in_any_zone(spark):
    rows = spark.sql("select timestamp'2024-03-01 12:00:00Z' as t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert rows.select(keys.rfc3339(F.col("t"))).first()[0] == "2024-03-01T12:00:00Z"
            texts = spark.createDataFrame([("2024-03-01T12:00:00Z",), ("2024-03-01t21:00:00.5+09:00",), ("2024-03-01",), ("x",), (None,)], "s string")
            got = [x[0] for x in texts.select(F.unix_micros(keys.parse_rfc3339(F.col("s")))).collect()]
            assert got == [1_709_294_400_000_000, 1_709_294_400_500_000, None, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_walks_report_directories_after_their_contents(spark):
    names = [("b", "F"), ("a/x", "F"), ("a", "D"), ("a/c/z", "F"), ("a/c", "D"), ("a.txt", "F"), ("", "D")]
    rows = spark.createDataFrame([(p, k, bytearray(b"\x01")) for p, k in names], "path string, kind string, digest binary")
    assert [x.path for x in rows.orderBy(walk.walk_order()).collect()] == ["a/c/z", "a/c", "a/x", "a", "a.txt", "b", ""]
    lines = lambda **o: {x.path: x.line for x in walk.listing(rows, **o).collect()}
    assert lines(summarize=True) == {"": "040000 tree 01\t."}
    assert set(lines(blob_only=True)) == {"b", "a/x", "a/c/z", "a.txt"} and lines()["b"] == "100644 blob 01\tb"
    assert set(lines(max_depth=1)) == {"a", "b", "a.txt"} and "" in lines(show_root=True)
    good, bad = walk.checked(rows, 1), walk.checked(rows, 32)
    assert good.count() == 7
    try:
        bad.collect()
        raise AssertionError("a short digest must be an error")
    except Exception as e:
        assert "32 bytes" in str(e)


def test_tree_over_64_bit_hashes(spark):
    files = {"a/x": b"12345678", "a/y": b"abcdefgh", "z": b"qwertyui"}
    rows = spark.createDataFrame([(0, p, bytearray(d)) for p, d in files.items()], "tree int, path string, digest binary")
    one = lambda entries: xxhash.xxh64(b"".join(sorted(k + n + b"\0" + d for k, n, d in entries))).intdigest().to_bytes(8, "little")
    a = one([(b"F", b"x", files["a/x"]), (b"F", b"y", files["a/y"])])
    want = one([(b"D", b"a", a), (b"F", b"z", files["z"])])
    assert bytes(tree.roots(rows, digest=tree.fast_digest).first().digest) == want


def test_debounce_of_a_stretch_without_gaps(spark):
    events = [("hot", t) for t in range(0, 5000, 3)] + [("b", 1), ("b", 1), ("b", 500), (None, 3), (None, 9), ("n", None)]
    out = debounce.sessions(spark.createDataFrame(events, "k string, t long"), key="k", time="t", quiet=60, max_delay=600)
    got = sorted((x.k or "", x.first, x.last, x.n_events, x.fired_at, x.reason) for x in out.collect())
    hot = [x for x in got if x[0] == "hot"]
    assert sum(x[3] for x in hot) == len(range(0, 5000, 3)) and all(x[4] == x[1] + 600 and x[5] == "max_delay" for x in hot[:-1])
    assert [x for x in got if x[0] != "hot"] == [("", 3, 9, 2, 69, "quiet"), ("b", 1, 1, 2, 61, "quiet"), ("b", 500, 500, 1, 560, "quiet")]
    assert debounce.sessions(out.select("k", F.col("first").alias("t")).limit(0), key="k", time="t", quiet=1, max_delay=2).count() == 0


def tables(spark, snapshots, entries, objects, stores, replicas):
    e = spark.createDataFrame(entries, "repository_id long, snapshot_id long, path string, status int, object_id long, mtime long, depth int")
    return exchange.Tables(
        spark.createDataFrame(snapshots, "snapshot_id long, repository_id long, parent_id long, created_at long, source_machine_id long, source_snapshot_id long"),
        e, state.latest(e), spark.createDataFrame(objects, "object_id long, digest string, size long"),
        spark.createDataFrame(stores, "store_id long, name string, url string"),
        spark.createDataFrame(replicas, "object_id long, store_id long, path string, encrypted boolean"),
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_push_apply_is_idempotent(spark):
    here = tables(spark, [(5, 0, None, 10, None, None)], [(0, 5, "a", 1, 1, 1, 0)], [(1, "d1", 3)], [(1, "s", "u")], [(1, 1, "objects/d1", False)])
    snaps = spark.createDataFrame([(7, 100, 20), (7, 101, 30), (7, 101, 30)], "source_machine_id long, source_snapshot_id long, created_at long")
    rows = [(7, 100, "a", 0, None, None, 2), (7, 100, "b/c", 1, "d2", 4, 2), (7, 101, "d", 1, "d1", 3, 3), (7, 101, "bad", 1, "d9", None, 3)]
    rows = spark.createDataFrame(rows, "source_machine_id long, source_snapshot_id long, path string, status int, digest string, size long, mtime long")
    reps = spark.createDataFrame([("d2", "t", "v", "p", False), ("d1", "s", "u", "q", True), ("dx", "t", "v", "r", False)], "digest string, store string, url string, path string, encrypted boolean")
    once = exchange.push_apply(here, 0, snaps, rows, reps)
    assert rows_of(once.snapshots.select("snapshot_id", "parent_id", "source_snapshot_id")) == [(5, None, None), (6, 5, 100), (7, 6, 101)]
    assert rows_of(once.cache.select("path", "status", "object_id")) == [("a", 0, None), ("b/c", 1, 2), ("d", 1, 1)]
    assert rows_of(once.objects) == [(1, "d1", 3), (2, "d2", 4)] and rows_of(once.stores) == [(1, "s", "u"), (2, "t", "v")]
    assert rows_of(once.replicas) == [(1, 1, "objects/d1", False), (2, 2, "p", False)]
    twice = exchange.push_apply(once, 0, snaps, rows, reps)
    for name in ("snapshots", "entries", "cache", "objects", "stores", "replicas"):
        assert rows_of(getattr(twice, name)) == rows_of(getattr(once, name)), name


def test_push_after_scan_and_pull_and_copy(spark):
    here = tables(spark, [(1, 0, None, 10, None, None)], [(0, 1, "a", 1, 1, 1, 0), (0, 1, "b", 1, 1, 1, 0)], [(1, "d1d1", 3)], [(1, "s", "u")], [])
    empty = tables(spark, [], [], [], [], [])
    there, plan = exchange.push_after_scan(here, empty, 0, 9, 0, 1)
    assert rows_of(plan.select("path", "action")) == [("a", "push"), ("b", "skip")]
    assert rows_of(there.cache.select("path", "object_id")) == [("a", 1), ("b", 1)] and there.replicas.count() == 1
    after, copies = exchange.pull_and_copy(empty, there, 0, 3, 0, 1, 2)
    assert after.entries.count() == 2 and [x.from_path for x in copies.collect()] == ["objects/d1/d1/d1d1"]


def test_small_things(spark):
    cache = spark.createDataFrame([(0, "a", 1, 5, 0o040000), (0, "b%", 0, None, 0o100644), (1, "a", 0, None, 0)], "repository_id long, path string, status int, object_id long, mode int")
    assert [x.path for x in listing.files(cache, 0, "%", wildcards=True).collect()] == ["a"] and listing.files(cache, 0, "%").count() == 0
    assert rows_of(diff.cross_deleted(cache, 0, 1)) == [(1, "b%"), (2, "a")]
    assert listing.by_hex_prefix(spark.createDataFrame([(1, "ab")], "object_id long, digest string"), "").first().matches == 1
    assert summary.as_json_lines(cache.where("path = 'a' and status = 1").select("path", "object_id")).first().line == '{"path":"a","object_id":5}'
    api = listing.api_rows(cache.withColumn("snapshot_id", F.lit(1)).withColumn("mtime", F.current_timestamp()), spark.createDataFrame([(5, "d", 1)], "object_id long, digest string, size long"))
    assert {x.path: x.is_directory for x in api.where("repository_id = '0'").collect()} == {"a": True, "b%": False}


def test_push_carries_modes_messages_and_fast_digests(spark):
    here = tables(spark, [], [], [], [], [])
    snaps = spark.createDataFrame([(7, 1, 10, "first", '{"k":1}'), (7, 2, 20, None, None)], "source_machine_id long, source_snapshot_id long, created_at long, message string, metadata string")
    schema = "source_machine_id long, source_snapshot_id long, path string, status int, digest string, size long, mtime long, fast_digest long, mode int"
    rows = spark.createDataFrame([(7, 1, "a", 1, "d1", 3, 1, 11, 0o100755), (7, 1, "b", 1, "d2", 4, 1, None, 0o100644), (7, 2, "c", 1, "d1", 3, 2, 12, None), (7, 2, "a", 0, None, None, None, None, None)], schema)
    none = spark.createDataFrame([], "digest string, store string, url string, path string, encrypted boolean")
    once = exchange.push_apply(here, 0, snaps, rows, none)
    assert rows_of(once.snapshots.select("snapshot_id", "message", "metadata")) == [(1, "first", '{"k":1}'), (2, None, None)]
    assert rows_of(once.entries.select("snapshot_id", "path", "status", "mode")) == [(1, "a", 1, 0o100755), (2, "a", 0, None), (2, "c", 1, None)]
    assert rows_of(once.objects.select("digest", "fast_digest")) == [("d1", 11)]
    later = spark.createDataFrame([(7, 3, 30, "third", None)], snaps.schema)
    rows = spark.createDataFrame([(7, 3, "d", 1, "d1", 3, 3, 99, 0o120777)], schema)
    twice = exchange.push_apply(once, 0, later, rows, none)
    assert rows_of(twice.objects.select("digest", "fast_digest")) == [("d1", 11)] and rows_of(twice.cache.select("path", "mode")) == [("a", None), ("c", None), ("d", 0o120777)]
    assert rows_of(twice.snapshots.select("snapshot_id", "parent_id", "message")) == [(1, None, "first"), (2, 1, None), (3, 2, "third")]


def test_verified_moments_orders_and_exclusive_filters(spark):
    replicas = spark.createDataFrame([(1, 1, "p", False), (2, 1, "q", False)], "object_id long, store_id long, path string, encrypted boolean")
    found = spark.createDataFrame([(1, 1, "ok"), (2, 1, "corrupt")], "object_id long, store_id long, result string")
    moment = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    once = content.mark_verified(replicas, found, moment)
    assert [(r.object_id, str(r.verified_at)) for r in once.orderBy("object_id").collect()] == [(1, "2024-01-02 03:04:05"), (2, "None")]
    again = content.mark_verified(once, found.where("object_id = 2"), moment)
    assert [str(r.verified_at) for r in again.orderBy("object_id").collect()] == ["2024-01-02 03:04:05", "None"]
    snaps = spark.createDataFrame([(3, 5), (1, 5), (2, 1)], "snapshot_id long, created_at long")
    assert [r.snapshot_id for r in state.in_order(snaps).collect()] == [2, 1, 3]
    cache = spark.createDataFrame([(0, "a/b", 1, 1), (0, "a/c/d", 1, 2)], "repository_id long, path string, status int, depth int")
    assert listing.listed(cache, 0, prefix="a/").count() == 2 and [r.path for r in listing.listed(cache, 0, directory="a").collect()] == ["a/b"]
    with pytest.raises(ValueError, match="exclude each other"):
        listing.listed(cache, 0, prefix="a", directory="a")
