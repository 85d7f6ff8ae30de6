"""Incremental exchange of snapshots with a peer: what to send, and how what arrives is merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import content, state


def pull_rows(snapshots: DataFrame, entries: DataFrame, objects: DataFrame, repository_id: int, cursor: int) -> DataFrame:
    """The rows of all snapshots of a repository created after the cursor's."""
    mine = snapshots.where(F.col("repository_id") == repository_id)
    rows = state.after(mine, cursor).select("snapshot_id", "created_at", "parent_id").join(entries.where(F.col("repository_id") == repository_id).drop("repository_id"), "snapshot_id")
    return rows.join(objects, "object_id", "left").select("snapshot_id", "created_at", "parent_id", "path", "status", "digest", "size", "mtime")


def pull_replicas(rows: DataFrame, objects: DataFrame, replicas: DataFrame, stores: DataFrame) -> DataFrame:
    """(digest, path, store) behind pulled rows, one per digest and path: of several stores the first by name."""
    ids = rows.select("digest").where("digest is not null").distinct().join(objects, "digest").select("digest", "object_id")
    named = ids.join(replicas, "object_id").join(stores.select("store_id", "name"), "store_id")
    return named.groupBy("digest", "path").agg(F.min("name").alias("store"))


def pull_payload(rows: DataFrame) -> DataFrame:
    """One nested row per snapshot: its entries as an array sorted by path."""
    entry = F.struct("path", "status", "digest", "size")
    return rows.groupBy("snapshot_id", "created_at", "parent_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def flatten_payload(payload: DataFrame) -> DataFrame:
    return payload.select("snapshot_id", "created_at", "parent_id", F.inline("entries"))


def new_arrivals(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Snapshots that have not been applied: each (source_machine_id, source_snapshot_id) is applied once."""
    return incoming.join(existing.select("source_machine_id", "source_snapshot_id"), ["source_machine_id", "source_snapshot_id"], "left_anti")


def acceptable(entries: DataFrame) -> DataFrame:
    """Rows that can be applied: present ones need a digest and a size, and a fast digest where rows have one, others are skipped."""
    needed = [F.col(c).isNotNull() for c in ("digest", "size", "fast_digest") if c in entries.columns]
    return entries.where((F.col("status") == 0) | reduce(Column.__and__, needed))


def merge_cache(cache: DataFrame, arriving: DataFrame) -> DataFrame:
    """The cache after entries arrive: the newest row of every path."""
    cols = ["repository_id", "path", "snapshot_id", "status", "object_id", "mtime", "depth"]
    have = lambda rows: rows.select(*cols, *(c for c in ("mode",) if c in rows.columns))
    return state.latest(have(cache).unionByName(have(arriving), allowMissingColumns=True))


def apply_pull(local: DataFrame, arriving: DataFrame, first_id: int) -> DataFrame:
    """Local snapshots for remote ones (source_snapshot_id, created_at): consecutive ids in their order, each the parent of the next.

    ``local``: the repository's snapshots; its newest one becomes the parent of the first.
    """
    ordered = arriving.withColumn("__order", F.struct("created_at", "source_snapshot_id"))
    return chained(local, content.numbered(ordered, "__order", first_id, "snapshot_id").drop("__order"), first_id)


def chained(local: DataFrame, numbered: DataFrame, first_id: int) -> DataFrame:
    """Adds parent_id to snapshots with consecutive ids: the one before, and for the first the newest of ``local``."""
    head = local.agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("head"))
    rows = numbered.crossJoin(F.broadcast(head))  # one row
    return rows.withColumn("parent_id", F.when(F.col("snapshot_id") == first_id, F.col("head")).otherwise(F.col("snapshot_id") - 1)).drop("head")


def advance(peers: DataFrame, pulled: DataFrame) -> DataFrame:
    """Peers with their cursor moved to the newest snapshot pulled for their repository."""
    last = pulled.groupBy("repository_id").agg(F.max("snapshot_id").alias("pulled"))
    return peers.join(last, "repository_id", "left").withColumn("last_snapshot_id", F.greatest("last_snapshot_id", "pulled")).drop("pulled")
