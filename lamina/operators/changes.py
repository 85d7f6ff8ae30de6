"""What an observation of a path means: classification against the state before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths

CHANGED = ("added", "modified", "deleted")


def classify(observations: DataFrame) -> DataFrame:
    """Adds ``change`` to (repository_id, snapshot_id, path, status, object_id, ...): one shuffle on the path.

    added, modified, deleted and unchanged against the path's previous observation; noop if a missing path stays missing.
    """
    by = Window.partitionBy("repository_id", "path").orderBy("snapshot_id")
    was, old = F.coalesce(F.lag("status").over(by), F.lit(0)), F.lag("object_id").over(by)
    status = F.col("status")
    change = (
        F.when((status == 0) & (was == 0), "noop")
        .when(status == 0, "deleted")
        .when(was == 0, "added")
        .when(F.col("object_id") == old, "unchanged")
        .otherwise("modified")
    )
    return observations.withColumn("change", change)


def delta_entries(changes: DataFrame) -> DataFrame:
    """What a snapshot stores: changed paths only."""
    rows = changes.where(F.col("change").isin(*CHANGED))
    return rows.select("repository_id", "snapshot_id", "path", "status", "object_id", "mtime", paths.depth(F.col("path")).alias("depth"), "change")


def counters(changes: DataFrame) -> DataFrame:
    """Scan counters of every snapshot."""
    n = lambda c: F.count_if(F.col("change") == c).alias(c)
    return changes.groupBy("repository_id", "snapshot_id").agg(F.count_if(F.col("status") == 1).alias("scanned"), n("added"), n("modified"), n("unchanged"), n("deleted"))


def keep_nonempty(snapshots: DataFrame, entries: DataFrame, *, allow_empty: bool = False) -> DataFrame:
    """Snapshots that are not discarded: those with a change, or all of them."""
    return snapshots if allow_empty else snapshots.join(entries.select("snapshot_id").distinct(), "snapshot_id", "left_semi")


def scan_against_cache(walked: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, change, refresh_mtime) of walked files (path, size, mtime, fast_digest) against a repository's cache.

    Same size and time: unchanged; else same fast digest: unchanged, its time refreshed; else modified, or added where
    the path was absent or deleted. Cached present paths that were not walked are deleted.
    """
    c = cache.where("status = 1").select("path", *(F.col(k).alias(f"c_{k}") for k in ("size", "mtime", "fast_digest")), F.lit(True).alias("known"))
    rows = walked.withColumn("seen", F.lit(True)).join(c, "path", "full_outer")
    same = F.col("size").eqNullSafe(F.col("c_size")) & F.col("mtime").eqNullSafe(F.col("c_mtime"))
    fast = F.coalesce(F.col("fast_digest") == F.col("c_fast_digest"), F.lit(False))
    change = F.when(F.col("seen").isNull(), "deleted").when(F.col("known").isNull(), "added").when(same | fast, "unchanged").otherwise("modified")
    return rows.select("path", change.alias("change"), (F.col("seen").isNotNull() & F.col("known").isNotNull() & ~same & fast).alias("refresh_mtime"))


def status_fast(walked: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, state) against the cache by size, then time; a path without a cached time counts as unmodified."""
    return _status(walked, cache, (F.col("size") != F.col("c_size")) | F.coalesce(F.col("mtime") != F.col("c_mtime"), F.lit(False)), ("size", "mtime"))


def status_hash(walked: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, state) against the cache by digest."""
    return _status(walked, cache, ~F.col("digest").eqNullSafe(F.col("c_digest")), ("digest",))


def _status(walked: DataFrame, cache: DataFrame, differs, cols: tuple[str, ...]) -> DataFrame:
    c = cache.where("status = 1").select("repository_id", "path", *(F.col(k).alias(f"c_{k}") for k in cols), F.lit(True).alias("known"))
    rows = walked.select("repository_id", "path", *cols, F.lit(True).alias("seen")).join(c, ["repository_id", "path"], "full_outer")
    state = F.when(F.col("seen").isNull(), "deleted").when(F.col("known").isNull(), "added").when(differs, "modified").otherwise("unmodified")
    return rows.select("repository_id", "path", state.alias("state"))


def verify(cache: DataFrame, files: DataFrame) -> DataFrame:
    """(path, result) for every cached present path: OK, MODIFIED, MISSING, or ERROR where a file has no digest."""
    f = files.select("repository_id", "path", F.col("digest").alias("f_digest"), F.lit(True).alias("seen"))
    rows = cache.where("status = 1").join(f, ["repository_id", "path"], "left")
    result = F.when(F.col("seen").isNull(), "MISSING").when(F.col("f_digest").isNull(), "ERROR").when(F.col("f_digest") == F.col("digest"), "OK").otherwise("MODIFIED")
    return rows.select("repository_id", "path", result.alias("result"))
