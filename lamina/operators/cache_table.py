"""A live cache as a table in hash buckets of (repository, path), with a manifest for each version.

A batch writes its own newest rows, as a run of each bucket it touches; a bucket with RUNS runs is merged into one in the same
step. Readers take a version's runs and the newest row of each path in them. What a batch writes follows the batch, but
for one merge in RUNS.

Order of steps: data to a new folder, then the manifest of the version, in one step, then what no kept version names is
deleted. A batch that ends between any two steps and is run again finds its manifest, or none and starts anew; what the
first attempt left is deleted.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete, names, put_once
from . import state, sync

#: Buckets of a new table; runs of a bucket at which they are merged; versions that readers may still hold.
BUCKETS, RUNS, KEPT = 64, 8, 2
COLUMNS = ["repository_id", "path", "snapshot_id", "status", "object_id", "mtime", "depth"]


def bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("repository_id", "path"), F.lit(n)).cast("int")


def versions(spark: SparkSession, base: str) -> list[int]:
    """Those that have a manifest, the oldest first."""
    return sorted(int(m[1]) for x in names(spark, f"{base}/manifests") if (m := re.fullmatch(r"v(\d+)\.json", x)))


def manifest(spark: SparkSession, base: str, version: int) -> dict:
    """{buckets, schema, runs: {bucket: [folders, the oldest first]}}; as large as the number of buckets and runs."""
    return json.loads(spark.read.text(f"{base}/manifests/v{version}.json", wholetext=True).first()[0])


def _runs(spark: SparkSession, base: str, schema, found: dict, some: set[int] | None = None) -> DataFrame:
    paths = [f"{base}/data/{folder}/bucket={b}" for b, folders in found["runs"].items() if some is None or int(b) in some for folder in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, base: str, *, version: int | None = None, repository_id: int | None = None, path: str | None = None) -> DataFrame:
    """The newest row of every path, of the newest version or the one given; of one path alone, from its bucket, if both keys are given."""
    known = versions(spark, base)
    if not known:
        raise FileNotFoundError(f"no version of a cache in {base}")
    found = manifest(spark, base, known[-1] if version is None else version)
    some = None
    if repository_id is not None and path is not None:
        key = spark.range(1).select(F.lit(repository_id).cast("long").alias("repository_id"), F.lit(path).alias("path"))
        some = {key.select(bucket(found["buckets"])).first()[0]}
    rows = _runs(spark, base, found["schema"], found, some)
    rows = rows if repository_id is None else rows.where(F.col("repository_id") == repository_id)
    rows = rows if path is None else rows.where(F.col("path") == path)
    return state.latest(rows)


def apply(batch: DataFrame, base: str, epoch: int, *, buckets: int = BUCKETS) -> None:
    """Version epoch + 1: version epoch with the rows of ``batch`` (COLUMNS) taken in. Does nothing if it is there already.

    Of rows of one path and snapshot, in a batch or across batches, any one stays. A batch without rows makes a version too. An
    epoch after 0 whose version is missing is an error. ``buckets`` holds for a new table.
    """
    spark, known = batch.sparkSession, versions(batch.sparkSession, base)
    if epoch + 1 not in known:
        if epoch and epoch not in known:
            raise FileNotFoundError(f"batch {epoch} needs version {epoch} of {base}")
        rows = batch.select(COLUMNS)
        old = manifest(spark, base, epoch) if epoch else {"buckets": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "runs": {}}
        n = old["buckets"]
        newest = state.latest(rows).withColumn("bucket", bucket(n))
        folder = f"{epoch:012d}-{uuid.uuid4().hex}"
        touched = {r["bucket"] for r in newest.select("bucket").distinct().collect()}  # at most the number of buckets
        full = {b for b in touched if len(old["runs"].get(str(b), [])) + 1 >= RUNS}
        if full:
            merged = sync.merge_cache(_runs(spark, base, old["schema"], old, full), newest.where(F.col("bucket").isin(full)))
            newest = newest.where(~F.col("bucket").isin(full)).unionByName(merged.withColumn("bucket", bucket(n)))
        if touched:
            newest.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{base}/data/{folder}")
        runs = {str(b): [folder] if b in full else [*old["runs"].get(str(b), []), folder] for b in touched}
        _commit(spark, base, epoch + 1, {**old, "runs": {**old["runs"], **runs}})
    _clean(spark, base, epoch + 1)


def _commit(spark: SparkSession, base: str, version: int, content: dict) -> None:
    put_once(spark, f"{base}/manifests/v{version}.json", json.dumps(content))


def _clean(spark: SparkSession, base: str, newest: int) -> None:
    """Deletes manifests older than the KEPT newest and folders of data that no kept one names."""
    known = [v for v in versions(spark, base) if v <= newest]
    for v in known[:-KEPT]:
        delete(spark, f"{base}/manifests/v{v}.json")
    named: dict[str, set[str]] = {}
    for v in known[-KEPT:]:
        for b, folders in manifest(spark, base, v)["runs"].items():
            for folder in folders:
                named.setdefault(folder, set()).add(f"bucket={b}")
    for folder in names(spark, f"{base}/data"):
        if folder not in named:
            delete(spark, f"{base}/data/{folder}")
            continue
        for x in names(spark, f"{base}/data/{folder}"):
            if x.startswith("bucket=") and x not in named[folder]:
                delete(spark, f"{base}/data/{folder}/{x}")
