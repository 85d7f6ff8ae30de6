"""Differences between snapshots and between repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import state


def side(entries: DataFrame, snapshot_id: int, mode: str, prefix: str = "", repository_id: int | None = None) -> DataFrame:
    """Present paths of a snapshot: its own delta rows (mode "delta") or the state it stands for ("state").

    A repository that is given is not looked up, and prunes the scan.
    """
    entries = entries if repository_id is None else entries.where(F.col("repository_id") == repository_id)
    if mode == "delta":
        rows = entries.where((F.col("snapshot_id") == snapshot_id) & (F.col("status") == 1))
    elif mode == "state":
        rows = state.as_of(entries, snapshot_id) if repository_id is None else state.as_of_in(entries, repository_id, snapshot_id)
    else:
        raise ValueError(f"mode is delta or state, not {mode!r}")
    return rows.where(F.col("path").startswith(prefix)) if prefix else rows


def snapshot_diff(entries: DataFrame, objects: DataFrame, left: int, right: int, *, mode: str = "state", prefix: str = "", repository_id: int | None = None) -> DataFrame:
    """(path, change, size_before, size_after): A only right, D only left, M on both with other content; equal paths are left out."""
    part = lambda s, k: side(entries, s, mode, prefix, repository_id).select("path", F.col("object_id").alias(f"object_{k}"), F.lit(True).alias(f"in_{k}"))
    rows = part(left, "before").join(part(right, "after"), "path", "full_outer")
    change = F.when(F.col("in_before").isNull(), "A").when(F.col("in_after").isNull(), "D").when(~F.col("object_before").eqNullSafe(F.col("object_after")), "M")
    rows = rows.withColumn("change", change).where("change is not null")
    for k in ("before", "after"):  # sizes are looked up for what changed only
        rows = rows.join(objects.select(F.col("object_id").alias(f"object_{k}"), F.col("size").alias(f"size_{k}")), f"object_{k}", "left")
    return rows.select("path", "change", "size_before", "size_after")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def by_object(entries: DataFrame, left: int, right: int, *, mode: str = "state", prefix: str = "", repository_id: int | None = None) -> DataFrame:
    """(object_id, left_paths, right_paths): where each content is on either side, paths sorted."""
    tagged = lambda s, k: side(entries, s, mode, prefix, repository_id).select("object_id", "path", F.lit(k).alias("side"))
    return _paths_by_object(tagged(left, 1).union(tagged(right, 2)))


def _paths_by_object(rows: DataFrame) -> DataFrame:
    paths = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("path"))))
    return rows.groupBy("object_id").agg(paths(1).alias("left_paths"), paths(2).alias("right_paths"))


def move_classes(grouped: DataFrame) -> DataFrame:
    """Adds ``class``: added, deleted, same (equal path lists) or moved."""
    kind = F.when(F.size("left_paths") == 0, "added").when(F.size("right_paths") == 0, "deleted").when(F.col("left_paths") == F.col("right_paths"), "same").otherwise("moved")
    return grouped.withColumn("class", kind)


def cross_repository(cache: DataFrame, left_repo: int, right_repo: int, *, left_prefix: str = "", right_prefix: str = "", limit: int | None = None) -> DataFrame:
    """(object_id, left_paths, right_paths) of present paths over two repositories' caches; ``cross_deleted`` has the deleted ones.

    ``limit``: more rows than this on a side, deleted ones too, are an error, found when the result is computed.
    """
    rows = _both(cache, left_repo, right_repo, left_prefix, right_prefix)
    if limit is not None:
        most = rows.groupBy("side").count().agg(F.max("count").alias("most"))
        guard = F.when(F.col("most") > limit, F.raise_error(F.lit(f"more than {limit} rows on a side"))).otherwise(F.lit(True))
        rows = rows.crossJoin(F.broadcast(most)).where(guard).drop("most")  # one row
    return _paths_by_object(rows.where("status = 1"))


def _both(cache: DataFrame, left_repo: int, right_repo: int, left_prefix: str, right_prefix: str) -> DataFrame:
    one = lambda repo, k, p: cache.where((F.col("repository_id") == repo) & F.col("path").startswith(p)).select("object_id", "path", "status", F.lit(k).alias("side"))
    return one(left_repo, 1, left_prefix).union(one(right_repo, 2, right_prefix))


def cross_deleted(cache: DataFrame, left_repo: int, right_repo: int, *, left_prefix: str = "", right_prefix: str = "") -> DataFrame:
    """(side, path) of the deleted paths, side 1 or 2."""
    return _both(cache, left_repo, right_repo, left_prefix, right_prefix).where("status = 0").select("side", "path")
