"""A live cache in buckets: batches, reruns after a stop between any two steps, what is written and what is deleted."""

import os
import random

import pytest

from lamina import scratch
from lamina.operators import cache_table as ct
from lamina.streaming import ingest

from .test_sources_and_streams import ENTRY


def batches(seed, n, paths=60):
    r, out, snapshot = random.Random(seed), [], 0
    for _ in range(n):
        rows = []
        for _ in range(r.randrange(1, 4)):
            snapshot += 1
            for k in r.sample(range(paths), r.randrange(1, 8)):
                gone = r.random() < 0.3
                rows.append((k % 3, f"d/{k}", snapshot, 0 if gone else 1, None if gone else r.randrange(9), snapshot, 1))
        out.append(rows)
    return out


def newest(rows):
    best = {}
    for x in rows:
        best[x[:2]] = max(best.get(x[:2], x), x, key=lambda y: y[2])
    return sorted(best.values())


def content(frame):
    return sorted((r.repository_id, r.path, r.snapshot_id, r.status, r.object_id, r.mtime, r.depth) for r in frame.collect())


def size(base):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{base}/data") for f in fs if f.endswith(".parquet"))


def test_batches_runs_and_cleaning(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ct, "RUNS", 3)
    base, seen = str(tmp_path / "t"), []
    for epoch, rows in enumerate([*batches(1, 7), []]):
        ct.apply(spark.createDataFrame(rows, ENTRY), base, epoch, buckets=4)
        ct.apply(spark.createDataFrame(rows, ENTRY), base, epoch)  # again: nothing happens
        seen += rows
        assert content(ct.read(spark, base)) == newest(seen)
        found = ct.manifest(spark, base, epoch + 1)
        assert found["buckets"] == 4 and all(len(x) < 3 for x in found["runs"].values())
    assert ct.versions(spark, base) == [7, 8]
    named = {(f, f"bucket={b}") for v in (7, 8) for b, fs in ct.manifest(spark, base, v)["runs"].items() for f in fs}
    assert {(f, b) for f in os.listdir(f"{base}/data") for b in os.listdir(f"{base}/data/{f}") if b.startswith("bucket=")} == named
    one = newest(seen)[0]
    assert content(ct.read(spark, base, repository_id=one[0], path=one[1])) == [one]
    with pytest.raises(FileNotFoundError):
        ct.apply(spark.createDataFrame([], ENTRY), base, 20)
    with pytest.raises(FileNotFoundError):
        ct.read(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("step", ["write", "draft", "commit", "clean"])
def test_stop_between_steps_and_rerun(spark, tmp_path, monkeypatch, step):
    base, seen, put, commit = str(tmp_path / "t"), [], scratch.put_once, ct._commit

    def stopped(*_):
        raise RuntimeError("stopped")

    def after_draft(spark, path, text):
        put(spark, path + ".half", text)
        stopped()

    def after_commit(*args):
        commit(*args)
        stopped()

    patch = {"write": ("_commit", stopped), "draft": ("put_once", after_draft), "commit": ("_commit", after_commit), "clean": ("_clean", stopped)}[step]
    for epoch, rows in enumerate(batches(2, 3)):
        frame = spark.createDataFrame(rows, ENTRY)
        before = content(ct.read(spark, base)) if epoch else None
        with monkeypatch.context() as m:
            m.setattr(ct, *patch)
            with pytest.raises(RuntimeError):
                ct.apply(frame, base, epoch, buckets=4)
        if before is not None and step in ("write", "draft"):
            assert content(ct.read(spark, base)) == before  # readers see the version before
        ct.apply(frame, base, epoch, buckets=4)
        seen += rows
        assert content(ct.read(spark, base)) == newest(seen)
        named = {f for v in ct.versions(spark, base) for fs in ct.manifest(spark, base, v)["runs"].values() for f in fs}
        assert {*os.listdir(f"{base}/data")} == named


def test_bytes_written_follow_the_batch(spark, tmp_path):
    base = str(tmp_path / "t")
    large = [(0, f"folder/{k}/file-{k * 7919 % 1000003}", 1, 1, k, k, 2) for k in range(40_000)]
    ct.apply(spark.createDataFrame(large, ENTRY), base, 0, buckets=16)
    whole = size(base)
    ct.apply(spark.createDataFrame([(0, large[5][1], 2, 0, None, 9, 2)], ENTRY), base, 1)
    assert size(base) - whole < whole / 50
    assert ct.read(spark, base).count() == 40_000 and ct.read(spark, base, repository_id=0, path=large[5][1]).first().status == 0


def test_stream_into_a_table(spark, tmp_path):
    source, base, check = (f"{tmp_path}/{x}" for x in ("in", "table", "check"))
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        seen = []
        for rows in batches(3, 2):
            seen += rows
            spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(source)
            ingest.maintain_table(ingest.snapshot_stream(spark, source, ENTRY), base, check).awaitTermination()
        assert content(ct.read(spark, base)) == newest(seen)
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_streams_without_success_files_lose_nothing(spark, tmp_path):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        source, base, check = (f"{tmp_path}/{x}" for x in ("in", "cache", "check"))
        for k in (1, 2):
            spark.createDataFrame([(0, f"p{k}", k, 1, k, k, 0)], ENTRY).coalesce(1).write.mode("append").parquet(source)
            ingest.maintain_cache(ingest.snapshot_stream(spark, source, ENTRY), base, check).awaitTermination()
        assert not os.path.exists(f"{base}/v2/_SUCCESS") and spark.read.parquet(f"{base}/v2").count() == 2
        schema, source, table, check = "source_machine_id int, source_snapshot_id long", *(f"{tmp_path}/{x}" for x in ("in2", "table", "check2"))
        for rows in ([(1, 1)], [(1, 1), (1, 2)]):
            spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
            ingest.ingest_once(ingest.snapshot_stream(spark, source, schema), table, check).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, 1), (1, 2)]
        scratch.delete(spark, f"{base}/v2")
        spark.createDataFrame([(0, "p3", 3, 1, 3, 3, 0)], ENTRY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with pytest.raises(Exception, match="needs what earlier batches wrote"):
            ingest.maintain_cache(ingest.snapshot_stream(spark, f"{tmp_path}/in", ENTRY), base, f"{tmp_path}/check").awaitTermination()
    finally:
        hadoop.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
