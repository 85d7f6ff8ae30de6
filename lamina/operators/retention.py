"""Garbage collection as plans: what would go, computed before anything does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import content


def prune_set(snapshots: DataFrame, *, keep_last: int | None = None, older_than: Column | None = None, days_alone: bool = False) -> DataFrame:
    """Snapshots to prune: beyond the newest ``keep_last`` of their repository and, if given, older than a moment.

    Without keep_last nothing is pruned, unless ``days_alone`` lets the age decide.
    """
    if keep_last is None and not (days_alone and older_than is not None):
        return snapshots.limit(0)
    newest = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    rows = snapshots.withColumn("rank", F.row_number().over(newest))
    rows = rows.where(F.col("rank") > (keep_last or 0))
    return (rows if older_than is None else rows.where(F.col("created_at") < older_than)).select(*snapshots.columns)


def orphans_dry_run(entries: DataFrame, objects: DataFrame, pruned: DataFrame) -> DataFrame:
    """(object_id, size): contents only in pruned snapshots, and those unreferenced already. Tree roots are not looked at."""
    used = entries.where("object_id is not null").select("object_id", "snapshot_id")
    gone = used.join(pruned.select("snapshot_id"), "snapshot_id", "left_semi").select("object_id").distinct()
    kept = used.join(pruned.select("snapshot_id"), "snapshot_id", "left_anti").select("object_id").distinct()
    exclusive = gone.join(kept, "object_id", "left_anti")
    ids = exclusive.union(content.unreferenced(objects, entries).select("object_id")).distinct()
    return objects.join(ids, "object_id", "left_semi").select("object_id", "size")


def orphans_live(entries: DataFrame, objects: DataFrame, pruned: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(object_id, size): contents that nothing refers to once the pruned snapshots' rows are gone; ``roots``: (snapshot_id, object_id)."""
    left = entries.join(pruned.select("snapshot_id"), "snapshot_id", "left_anti")
    kept_roots = None if roots is None else roots.join(pruned.select("snapshot_id"), "snapshot_id", "left_anti")
    return content.unreferenced(objects, left, kept_roots).select("object_id", "size")


def cache_after(cache: DataFrame, pruned: DataFrame, *, protect_live: bool = False) -> DataFrame:
    """Cache rows that stay: those not anchored at a pruned snapshot; ``protect_live`` keeps present paths too."""
    gone = pruned.select("snapshot_id")
    kept = cache.join(gone, "snapshot_id", "left_anti")
    return kept.unionByName(cache.join(gone, "snapshot_id", "left_semi").where("status = 1")) if protect_live else kept


def replica_actions(orphans: DataFrame, replicas: DataFrame, tags: DataFrame, *, store_ids: list[int] | None = None) -> DataFrame:
    """(object_id, n_replicas, n_in_scope, removable, tagged): an object goes if all its replicas are in the stores handled."""
    scope = F.lit(True) if store_ids is None else F.col("store_id").isin(store_ids)
    n = replicas.groupBy("object_id").agg(F.count("*").alias("n"), F.count_if(scope).alias("m"))
    tagged = tags.select("object_id").distinct().withColumn("tagged", F.lit(True))
    rows = orphans.select("object_id").join(n, "object_id", "left").join(tagged, "object_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("object_id", zero("n").alias("n_replicas"), zero("m").alias("n_in_scope"), (zero("n") == zero("m")).alias("removable"), F.coalesce("tagged", F.lit(False)).alias("tagged"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A table after its rows with a key in ``gone`` are deleted."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
