"""Rows in commits, and changes of a file tree as a stream."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from lamina.sources import commits, events
from lamina.streaming import debounce

from .test_sources_and_streams import make

SCHEMA = "path string, size long"


def rows_of(spark, n):
    return spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.col("id").alias("size")).repartition(3)


def sizes(base):
    out = {}
    for name in sorted(os.listdir(f"{base}/commits")):
        if name.endswith(".json"):
            with open(f"{base}/commits/{name}") as f:
                out[name] = [x for x in f.read().split("\n") if x]
    return out


@pytest.mark.parametrize(("n", "batch", "most"), [(100, 9, 9), (100, 0, 100), (100, -1, 100), (5, 1000, 5), (0, 10, 0)])
def test_commits_hold_a_bounded_number_of_rows(spark, tmp_path, n, batch, most):
    base = str(tmp_path / "t")
    made = commits.write(rows_of(spark, n), base, "job-1", batch_rows=batch)
    assert made == len(sizes(base)) and (batch > 0 or made == 1)
    for files in sizes(base).values():
        assert sum(spark.read.parquet(f"{base}/data/{f}").count() for f in files) <= max(most, 0)
    assert sorted(tuple(r) for r in commits.read(spark, base, SCHEMA).collect()) == sorted((f"f{k}", k) for k in range(n))
    assert commits.write(rows_of(spark, n), base, "job-1", batch_rows=batch) == made  # again: nothing happens
    assert commits.read(spark, base, SCHEMA).count() == n


def test_a_failing_task_leaves_no_row(spark, tmp_path):
    base = str(tmp_path / "t")
    commits.write(rows_of(spark, 10), base, "good", batch_rows=4)
    bad = rows_of(spark, 50).withColumn("size", F.when(F.col("size") == 37, F.raise_error(F.lit("unreadable"))).otherwise(F.col("size")).cast("long"))
    with pytest.raises(Exception, match="unreadable"):
        commits.write(bad, base, "bad", batch_rows=4)
    assert commits.read(spark, base, SCHEMA).count() == 10
    commits.write(rows_of(spark, 50), base, "bad", batch_rows=4)
    assert commits.read(spark, base, SCHEMA).count() == 60
    with pytest.raises(ValueError, match="has commits"):
        commits.discard(spark, base, "bad")
    with pytest.raises(ValueError, match="not a name"):
        commits.write(rows_of(spark, 1), base, "a/b")


def test_a_stop_between_commits_is_taken_up(spark, tmp_path, monkeypatch):
    base, commit, n = str(tmp_path / "t"), commits._commit, [0]

    def some(*args):
        n[0] += 1
        if n[0] == 3:
            raise RuntimeError("stopped")
        commit(*args)

    monkeypatch.setattr(commits, "_commit", some)
    with pytest.raises(RuntimeError):
        commits.write(rows_of(spark, 40), base, "j", batch_rows=5)
    assert 0 < commits.read(spark, base, SCHEMA).count() <= 10  # two whole commits
    made = commits.write(rows_of(spark, 40), base, "j", batch_rows=5)
    assert made >= 8 and commits.read(spark, base, SCHEMA).count() == commits.read(spark, base, SCHEMA).distinct().count() == 40


def test_many_commits_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FEW", 4)
    monkeypatch.setattr(commits, "DRAFTS", 20)
    base, commit, n = str(tmp_path / "t"), commits._commit, [0]
    commits.write(rows_of(spark, 8), base, "few", batch_rows=4)

    def some(*args):
        n[0] += 1
        if n[0] == 3:
            raise RuntimeError("stopped")
        commit(*args)

    monkeypatch.setattr(commits, "_commit", some)
    with pytest.raises(RuntimeError):
        commits.write(rows_of(spark, 500), base, "many", batch_rows=7)
    assert 8 < commits.read(spark, base, SCHEMA).count() <= 8 + 14  # two whole commits
    made, before = commits.write(rows_of(spark, 500), base, "many", batch_rows=7), sorted(os.listdir(f"{base}/data/many"))
    assert sum(x.endswith(".parquet") for x in before) <= 4  # a file for each task
    of_many = [files for name, files in sizes(base).items() if name.startswith("many.")]
    assert made == len(of_many) >= 72
    assert len({name.split("-")[1] for name in sizes(base) if name.startswith("many.")}) > 1  # drafted by several tasks
    rows = spark.read.parquet(f"{base}/data/many").groupBy(F.col("_metadata.file_name"), commits.NUMBER).count().collect()
    assert max(r[2] for r in rows) <= 7 and {f"many/{r[0]}\t{r[1]}" for r in rows} == {f for files in of_many for f in files}
    got = sorted(tuple(r) for r in commits.read(spark, base, SCHEMA).collect())
    assert got == sorted([(f"f{k}", k) for k in range(8)] + [(f"f{k}", k) for k in range(500)])
    assert commits.write(rows_of(spark, 500), base, "many", batch_rows=7) == made and len(sizes(base)) == made + len([x for x in sizes(base) if x.startswith("few.")])


def test_difference_of_listings():
    before, now = {"a": [1, 1], "b": [1, 1], "c": [2, 2]}, {"b": [1, 1], "c": [2, 3], "d": [4, 4]}
    assert [*events.difference(before, now)] == [("a", "remove", 1, 1), ("c", "modify", 2, 3), ("d", "create", 4, 4)]
    assert [*events.difference({}, {})] == []


def test_changes_appear_once_over_restarts(spark, tmp_path):
    root, state, out, check = (str(tmp_path / x) for x in ("r", "state", "out", "check"))
    make(root, ["a", "sub/b", "sub/deep/c", "other/d", ".git/x"])

    def batch():
        stream = events.file_events(spark, root, state)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.kind) for r in spark.read.schema(stream.schema).parquet(out).collect())

    seen = [("a", "create"), ("other/d", "create"), ("sub/b", "create"), ("sub/deep/c", "create")]
    assert batch() == seen
    assert batch() == seen  # nothing has changed
    with open(f"{root}/sub/b", "a") as f:
        f.write("more")
    os.unlink(f"{root}/a")
    shutil.rmtree(f"{root}/other")
    make(root, ["new/top/e", "z", "sub/x.db"])
    seen += [("sub/b", "modify"), ("a", "remove"), ("other/d", "remove"), ("new/top/e", "create"), ("z", "create"), ("sub/x.db", "create")]
    assert batch() == sorted(seen)
    assert batch() == sorted(seen)
    kept = debounce.relevant(spark.createDataFrame(seen, "path string, kind string")).collect()
    assert ("sub/x.db", "create") not in {tuple(r) for r in kept} and len(kept) == len(seen) - 1


def test_a_batch_that_is_read_again_takes_the_stored_listing(tmp_path):
    root, state = str(tmp_path / "r"), str(tmp_path / "s")
    make(root, ["a", "d/b"])
    stream = events._Stream({"path": root, "state": state})
    start, end = stream.initialOffset(), stream.latestOffset()
    first = [list(stream.read(p)) for p in stream.partitions(start, end)]
    make(root, ["c", "e/f"])
    again = [r for p in stream.partitions(start, end) for r in stream.read(p)]
    assert [r for x in first for r in x] == [r for r in again if r[0] != "e/f"]
    assert {r[0] for r in again} - {r[0] for x in first for r in x} <= {"e/f"}  # a folder that no task had listed
    later = [r[:2] for p in stream.partitions(end, stream.latestOffset()) for r in stream.read(p)]
    assert ("c", "create") in later and not any(r[0] in ("a", "d/b") for r in later)
