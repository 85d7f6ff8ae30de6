"""Encrypted blobs, blob stores and ids."""

import os

from pyspark.sql import functions as F

from lamina.functions import envelope, ids, paths
from lamina.sources import blobs

KEY, OTHER = bytes(range(32)), bytes(32)
TEXTS = [b"", b"x", b"y" * 8176, b"z" * 8177, os.urandom(40_000)]


def table(spark):
    return spark.createDataFrame([(k, bytearray(t)) for k, t in enumerate(TEXTS)], "k int, content binary")


def texts(rows):
    return [None if r.content is None else bytes(r.content) for r in sorted(rows.collect(), key=lambda r: r.k)]


def test_round_trips_and_headers(spark):
    for sealed, version in ((envelope.encrypt(table(spark), KEY, chunk_kind=0), 1), (envelope.encrypt_v0(table(spark), KEY), 0)):
        sealed = sealed.cache()
        assert texts(envelope.decrypt(sealed, KEY)) == TEXTS
        seen = envelope.inspect(sealed).collect()
        assert all((r.valid, r.version, r.chunk_size, r.algorithm) == (True, version, 8192, "aes256gcm") for r in seen)
        assert len({r.nonce for r in seen}) == len(TEXTS)
        assert texts(envelope.decrypt(sealed, OTHER)) == [None] * len(TEXTS)
        for broken in (F.expr("substring(content, 1, octet_length(content) - 1)"), F.concat("content", F.lit(b"!")), F.concat(F.lit(b"??"), F.expr("substring(content, 3)"))):
            assert texts(envelope.decrypt(sealed.withColumn("content", broken), KEY)) == [None] * len(TEXTS)
    cut = envelope.encrypt(table(spark).where("k = 4"), KEY, chunk_kind=0).withColumn("content", F.expr("substring(content, 1, 32 + 68 + 2 * 8192)"))
    assert texts(envelope.decrypt(cut, KEY)) == [None]  # whole chunks, but the last is missing


def test_names(spark):
    names = spark.createDataFrame([("a/ü.txt",), ("",)], "n string").withColumn("e", envelope.encrypt_name(F.col("n"), KEY, F.lit(bytes(range(12)))))
    assert all(set(r.e) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_") for r in names.collect())
    assert [r[0] for r in names.select(envelope.decrypt_name(F.col("e"), KEY)).collect()] == ["a/ü.txt", ""]
    assert names.select(envelope.decrypt_name(F.col("e"), OTHER)).first()[0] is None


def test_blob_stores(spark, tmp_path):
    root, store, back = (f"{tmp_path}/{x}" for x in ("root", "store", "back"))
    os.makedirs(root)
    for name in ("a", "b"):
        with open(f"{root}/{name}", "w") as f:
            f.write(name * 3)
    plan = spark.createDataFrame([("a", "aa" * 32), ("b", "ab" * 32), ("none", "ac" * 32)], "path string, h string").withColumn("blob_path", paths.blob_path(F.col("h")))
    assert {tuple(r) for r in blobs.upload(plan, root, store).collect()} == {("a", True), ("b", True), ("none", False)}
    listed = blobs.listing(spark, f"file://{store}")
    assert {(r.path, r.size) for r in listed.collect()} == {(f"objects/{p}/{p}/{p * 32}", 3) for p in ("aa", "ab")}
    wanted = plan.select(F.col("blob_path").alias("path"))
    assert blobs.existing(wanted, listed).count() == 2
    todo = plan.select("path", F.array(F.struct(F.lit("lost").alias("store"), F.col("blob_path").alias("replica_path")), F.struct(F.lit("s").alias("store"), F.col("blob_path").alias("replica_path"))).alias("candidates"))
    assert {tuple(r) for r in blobs.restore(todo, {"s": store, "lost": f"{tmp_path}/lost"}, back).collect()} == {("a", "s"), ("b", "s"), ("none", None)}
    assert sorted(os.listdir(back)) == ["a", "b"]


def test_ids(spark):
    row = spark.sql("select timestamp'2024-05-06 07:08:09.12' as t, 3 as s, 500 as m").withColumn("id", ids.build(F.col("t"), F.col("s"), F.col("m")))
    r = row.select(F.col("t") == ids.created_at(F.col("id")), ids.machine(F.col("id")), F.col("id") > 0).first()
    assert tuple(r) == (True, 500, True)
