"""Rows written in commits of a bounded number: all of a commit is visible or nothing, a failed task leaves nothing behind.

Spark's own committers stage the rows of a job and a draft of a small manifest for each commit, in tasks; then each commit is made by
moving its draft to its place, in one step. A job is named by its caller: run again after a stop, it makes the commits that are
missing from what is staged, or stages anew if that was not finished.

Up to FEW commits have files of their own. More share a file for each task: a manifest names the file and the number that its rows
carry there, so files are as many as tasks, not as commits.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..scratch import delete, exists, mover, names, put_once

#: Commits of a job that have files of their own.
FEW = 1000
#: Manifests that a task drafts, about: small rows, but a file each.
DRAFTS = 100
#: The column that tells a row's commit in a file which commits share.
NUMBER = "__commit"


def _staged(spark: SparkSession, base: str, job: str) -> bool:
    return f"{job}.json" in names(spark, f"{base}/staged")


def write(rows: DataFrame, base: str, job: str, *, batch_rows: int = 1000) -> int:
    """Number of commits of ``job`` (letters, digits, - and _): each of at most ``batch_rows`` rows, or one of all rows if that is not above 0.

    Rows come in no order between commits. A job without rows has one commit without files. Does nothing if all is there already.
    """
    if not re.fullmatch(r"[\w-]+", job):
        raise ValueError(f"not a name for a job: {job!r}")
    spark, drafts = rows.sparkSession, f"{base}/drafts/{job}"
    if not _staged(spark, base, job):
        for folder in (*_folders(base, job), drafts):
            delete(spark, folder)
        lines = _one(rows, base, job) if batch_rows <= 0 else _many(rows, base, job, batch_rows)
        lines.write.option("maxRecordsPerFile", 1).text(drafts)
        put_once(spark, f"{base}/staged/{job}.json", json.dumps({"commits": len(_drafts(spark, drafts)), "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)}))
    move = mover(spark, f"{base}/commits")
    for draft in _drafts(spark, drafts):
        _commit(move, f"{drafts}/{draft}", f"{job}.{draft.removesuffix('.txt')}.json")
    return json.loads(spark.read.text(f"{base}/staged/{job}.json", wholetext=True).first()[0])["commits"]


def _drafts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the manifests that are not in their place yet."""
    return sorted(x.rsplit("/", 1)[-1] for x in spark.read.text(folder).inputFiles())


def _folders(base: str, job: str) -> tuple[str, str]:
    """Where a job's rows are: in files of a task, and in files of a commit."""
    return f"{base}/data/{job}", f"{base}/data/{job}.each"


def _texts(spark: SparkSession, commits: list[list[str]]) -> DataFrame:
    return spark.createDataFrame([("\n".join(files),) for files in commits], "value string")


def _one(rows: DataFrame, base: str, job: str) -> DataFrame:
    """The manifest of a single commit."""
    folder, _ = _folders(base, job)
    rows.write.parquet(folder)
    return _texts(rows.sparkSession, [[f"{job}/{x}" for x in names(rows.sparkSession, folder) if x.endswith(".parquet")]]).coalesce(1)


def _many(rows: DataFrame, base: str, job: str, batch_rows: int) -> DataFrame:
    """The manifests of commits of ``batch_rows`` rows at most, whose rows are written here; a text for each."""
    spark, (folder, each) = rows.sparkSession, _folders(base, job)
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows.withColumn(NUMBER, F.floor(in_task / batch_rows)).write.parquet(folder)
    there = spark.read.schema(StructType([*rows.schema, StructField(NUMBER, LongType())])).parquet(folder)
    tops = there.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.max(NUMBER).alias("n"))
    n = tops.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    if n > FEW:
        numbered = tops.select("f", F.explode(F.sequence(F.lit(0), "n")).alias("k"))
        return numbered.select(F.concat(F.lit(f"{job}/"), "f", F.lit("\t"), F.col("k").cast("string")).alias("value")).repartition(n // DRAFTS + 1, "value")
    there.drop(NUMBER).write.option("maxRecordsPerFile", batch_rows).parquet(each)
    delete(spark, folder)
    return _texts(spark, [[f"{job}.each/{f}" for f in files] for files in _dealt(spark, rows.schema, each, batch_rows)])


def _dealt(spark: SparkSession, schema, folder: str, batch_rows: int) -> list[list[str]]:
    """Files put together while they stay within a commit's rows."""
    files = [x for x in names(spark, folder) if x.endswith(".parquet")]
    counts = spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).count()
    rows = {r["f"]: r["count"] for r in counts.collect()}  # a row for each file
    out, n = [[]], 0
    for f in files:
        if n + rows.get(f, 0) > batch_rows:
            out.append([])
            n = 0
        if f in rows:
            out[-1].append(f)
            n += rows[f]
    return out


def _commit(move: Callable[[str, str], None], draft: str, name: str) -> None:
    move(draft, name)


def read(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The rows of all commits."""
    if not exists(spark, f"{base}/commits"):
        return spark.createDataFrame([], schema)
    line = F.split("value", "\t")
    named = spark.read.text(f"{base}/commits").where("value <> ''").distinct()
    named = named.select(line[0].alias("__file"), F.get(line, F.lit(1)).cast("long").alias("__k"))
    rows = spark.read.schema(f"{schema}, {NUMBER} long").parquet(f"{base}/data/*")
    columns = rows.columns[:-1]
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = rows.select("*", F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("__in"))
    return rows.join(named, (F.col("__in") == F.col("__file")) & F.col(NUMBER).eqNullSafe(F.col("__k")), "left_semi").select(columns)


def discard(spark: SparkSession, base: str, job: str) -> None:
    """Deletes what a job that will not be run again has staged, if none of it is committed."""
    if any(x.startswith(f"{job}.") for x in names(spark, f"{base}/commits")):
        raise ValueError(f"{job} has commits")
    delete(spark, f"{base}/staged/{job}.json")
    for folder in (*_folders(base, job), f"{base}/drafts/{job}"):
        delete(spark, folder)
