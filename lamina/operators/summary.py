"""Counters of what a command did, and the orders in which its rows are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """One row: how many rows have each value of a column, under the names given."""
    return rows.agg(*(F.count_if(F.col(column) == value).alias(name) for value, name in names.items()))


def status_counts(states: DataFrame) -> DataFrame:
    return counts(states, "state", {"added": "added", "modified": "modified", "deleted": "deleted", "unmodified": "unmodified"})


def verify_counts(results: DataFrame) -> DataFrame:
    return counts(results, "result", {"OK": "ok", "MODIFIED": "modified", "MISSING": "missing", "ERROR": "errors"})


def store_verify_counts(results: DataFrame) -> DataFrame:
    return counts(results, "result", {"ok": "ok", "corrupt": "corrupt", "missing": "missing", "skipped": "skipped"})


def push_counts(plan: DataFrame, local: DataFrame) -> DataFrame:
    """pushed, skipped and errors of a push plan (path, action): a path to push that is not among the local files is an error."""
    there = plan.join(local.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    push = F.col("action") == "push"
    return there.agg(F.count_if(push & F.col("there")).alias("pushed"), F.count_if(~push).alias("skipped"), F.count_if(push & F.col("there").isNull()).alias("errors"))


def copy_counts(plan: DataFrame, present: DataFrame) -> DataFrame:
    """copied and skipped objects, and the bytes that move: what of ``present`` (object_id) is in the plan (object_id, size) is copied."""
    rows = present.select("object_id").distinct().join(plan.select("object_id", "size"), "object_id", "left")
    return rows.agg(F.count("size").alias("copied"), F.count_if(F.col("size").isNull()).alias("skipped"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("bytes"))


def restore_counts(plan: DataFrame, kept: DataFrame) -> DataFrame:
    """restored, skipped and errors of a restore plan (path, object_id, store): files in ``kept`` (path, object_id) are there already."""
    rows = plan.join(kept.select("path", "object_id", F.lit(True).alias("there")).distinct(), ["path", "object_id"], "left")
    gone = F.col("there").isNull()
    return rows.agg(F.count_if(gone & F.col("store").isNotNull()).alias("restored"), F.count_if(F.col("there")).alias("skipped"), F.count_if(gone & F.col("store").isNull()).alias("errors"))


def snapshot_counts(entries: DataFrame) -> DataFrame:
    """(snapshot_id, present, deleted) of every snapshot's own rows."""
    return entries.groupBy("snapshot_id").agg(F.count_if(F.col("status") == 1).alias("present"), F.count_if(F.col("status") == 0).alias("deleted"))


def side_counts(grouped: DataFrame) -> DataFrame:
    """added, deleted and kept (unchanged or moved) contents of rows that list the paths of both sides."""
    left, right = F.size("left_paths") > 0, F.size("right_paths") > 0
    return grouped.agg(F.count_if(~left).alias("added"), F.count_if(~right).alias("deleted"), F.count_if(left & right).alias("kept"))


def side_order() -> list[Column]:
    """Contents of the left side only, of the right side only, of both; then by their first path and id."""
    left, right = F.size("left_paths") > 0, F.size("right_paths") > 0
    first = F.coalesce(F.try_element_at("left_paths", F.lit(1)), F.try_element_at("right_paths", F.lit(1)))
    return [F.when(~right, 0).when(~left, 1).otherwise(2), first, F.col("object_id")]


def first_rows(rows: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first rows in an order; what is beyond never leaves its task."""
    return rows.orderBy(*order).limit(limit)


def object_page(references: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repository, snapshot_id, created_at, path, status) of where a content was seen, with the repositories' names."""
    named = references.join(repositories.select("repository_id", F.col("name").alias("repository")), "repository_id")
    return named.select("repository", "snapshot_id", "created_at", "path", "status")


def as_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON text for each row, null fields left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))
