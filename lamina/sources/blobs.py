"""Blob stores: listings through Spark's readers, uploads and restores that carry out a plan where files are mounted."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, url: str) -> DataFrame:
    """(path, size) of all blobs below a store's url (file, s3 and whatever else the cluster reads); contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(url).select("path", "length")
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url).toUri().getPath().rstrip("/") + "/"
    return found.select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("size"))


def existing(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    return wanted.join(listed.select("path"), "path", "left_semi")


def _put(source: str, target: str) -> None:
    """A copy that appears whole or not at all; a task that runs again finds it there."""
    if os.path.exists(target):
        return
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{uuid.uuid4().hex}"
    shutil.copyfile(source, part)
    os.replace(part, target)


def upload(plan: DataFrame, root: str, store: str) -> DataFrame:
    """(path, done) for a plan (path, blob_path): copies files below ``root`` to a store's folder, both mounted on every executor.

    Lazy like any frame: reading the result does the copying, once per row even if a task is run again.
    """

    def run(rows: Iterator) -> Iterator:
        for batch in rows:
            done = []
            for path, blob in zip(batch["path"], batch["blob_path"], strict=True):
                try:
                    _put(os.path.join(root, path), os.path.join(store, blob))
                    done.append(True)
                except OSError:
                    done.append(False)
            yield batch[["path"]].assign(done=done)

    return plan.select("path", "blob_path").mapInPandas(run, "path string, done boolean")


def restore(plan: DataFrame, stores: dict[str, str], target: str) -> DataFrame:
    """(path, store) for a plan (path, candidates: array of (store, replica_path)): the first replica that can be copied; null if none."""

    def first(path: str, candidates: Iterable) -> str | None:
        for x in candidates:
            try:
                _put(os.path.join(stores[x["store"]], x["replica_path"]), os.path.join(target, path))
                return x["store"]
            except (OSError, KeyError):
                continue
        return None

    def run(rows: Iterator) -> Iterator:
        for batch in rows:
            yield batch[["path"]].assign(store=[first(p, [] if c is None else c) for p, c in zip(batch["path"], batch["candidates"], strict=True)])

    return plan.select("path", "candidates").mapInPandas(run, "path string, store string")
