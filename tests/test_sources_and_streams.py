"""The file source, streams, and the driver's entry."""

import os
import time

from pyspark.sql import functions as F

from lamina.sources import files
from lamina.streaming import debounce, ingest


def make(root, names):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(name)


def test_file_tree(spark, tmp_path):
    root = str(tmp_path)
    make(root, ["readme.md", "src/lib/core/main.rs", "src/notes", ".hidden", ".git/config", "src/.git/x", "secret.env", "src/keep.log", "src/drop.log", "build/out"])
    with open(os.path.join(root, ".gitignore"), "w") as f:
        f.write("secret.env\nbuild/\n*.log\n!keep.log\n")
    got = {r.path: r for r in files.file_tree(spark, root).collect()}
    assert set(got) == {"readme.md", "src/lib/core/main.rs", "src/notes", ".hidden", ".gitignore", "src/keep.log"}
    assert got["readme.md"].size == 9 and got["readme.md"].mtime_ns == os.stat(os.path.join(root, "readme.md")).st_mtime_ns
    assert "build/out" in {r.path for r in files.file_tree(spark, root, ignore_files=False).collect()}
    assert ".git/config" in {r.path for r in files.file_tree(spark, root, skip_git=False).collect()}
    digests = {r.path: r.size for r in files.file_digests(spark, f"file://{root}/src").collect()}
    assert digests["notes"] == 9
    cache = files.file_tree(spark, root).where("path <> 'readme.md'").withColumn("status", F.lit(1))
    assert [r.path for r in files.changed_only(files.file_tree(spark, root), cache).collect()] == ["readme.md"]


ENTRY = "repository_id long, path string, snapshot_id long, status int, object_id long, mtime long, depth int"


def test_cache_follows_a_stream(spark, tmp_path):
    source, base, check = (f"{tmp_path}/{x}" for x in ("in", "cache", "check"))
    write = lambda rows: spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(source)
    write([(0, "a", 1, 1, 10, 1, 0), (0, "b", 1, 1, 11, 1, 0)])
    for batch in ([], [(0, "a", 2, 0, None, 2, 0), (0, "c", 2, 1, 12, 2, 0)]):
        if batch:
            write(batch)
        ingest.maintain_cache(ingest.snapshot_stream(spark, source, ENTRY), base, check).awaitTermination()
    newest = spark.read.parquet(ingest.cache_versions(base)(2))
    assert sorted((r.path, r.snapshot_id, r.status) for r in newest.collect()) == [("a", 2, 0), ("b", 1, 1), ("c", 2, 1)]


def test_ingestion_is_idempotent(spark, tmp_path):
    source, table, check = (f"{tmp_path}/{x}" for x in ("in", "table", "check"))
    schema = "source_machine_id int, source_snapshot_id long"
    for rows in ([(1, 1), (1, 1), (1, 2)], [(1, 2), (2, 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ingest.ingest_once(ingest.snapshot_stream(spark, source, schema), table, check).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, 1), (1, 2), (2, 1)]


def test_debounced_stream(spark, tmp_path):
    schema, source = "path string, kind string", f"{tmp_path}/in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([("a", "write"), ("a", "write"), ("x/.git/y", "write"), ("b", "access"), ("c.db", "write")], schema).coalesce(1).write.parquet(source)
    stream = debounce.relevant(spark.readStream.schema(schema).parquet(source))
    q = debounce.debounced(stream, key="path", quiet_ms=500, max_delay_ms=5000).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("fired").count():
            time.sleep(0.5)
        assert [(r.key, r.n_events, r.waited_ms) for r in spark.table("fired").collect()] == [("a", 2, 500)]
    finally:
        q.stop()


def test_entry_needs_no_corpus_package():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['lamina.llm'] = sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq = e.queries(); assert 'snapshot_diff_state' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
