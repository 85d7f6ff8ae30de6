"""Whole exchanges with a peer, composed of the pieces in ``sync``, ``content`` and ``state``: tables in, tables out.

``Tables`` is what one side holds. Nothing is changed in place: each operation returns the tables as they are
after it, to be written by the caller in one commit per table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import content, state, sync


@dataclass(frozen=True)
class Tables:
    """snapshots (snapshot_id, repository_id, parent_id, created_at, source_machine_id, source_snapshot_id), entries
    (repository_id, snapshot_id, path, status, object_id, mtime, depth), cache (as ``state.latest`` gives it), objects
    (object_id, digest, size), stores (store_id, name, url), replicas (object_id, store_id, path, encrypted)."""

    snapshots: DataFrame
    entries: DataFrame
    cache: DataFrame
    objects: DataFrame
    stores: DataFrame
    replicas: DataFrame


def _next(table: DataFrame, column: str) -> int:
    return (table.agg(F.max(column)).first()[0] or 0) + 1


def push_apply(here: Tables, repository_id: int, snapshots: DataFrame, entries: DataFrame, replicas: DataFrame) -> Tables:
    """What a repository's server holds after snapshots arrive from peers.

    snapshots: (source_machine_id, source_snapshot_id, created_at), entries: (source_machine_id, source_snapshot_id, path,
    status, digest, size, mtime), replicas: (digest, store, url, path, encrypted). Further columns go along where the arrival has
    them: message and metadata of snapshots, mode of entries, fast_digest of objects, without which a present row is skipped. Snapshots whose source is known are left
    out with all their rows, repeats in the arrival too; present rows without digest or size are skipped; objects, stores
    and replicas are created where they are missing; replicas of unknown objects are skipped. Each new snapshot's parent is
    the one before it, the first one's the newest that is here. Empty arrivals change nothing.
    """
    source = ["source_machine_id", "source_snapshot_id"]
    mine = here.snapshots.where(F.col("repository_id") == repository_id)
    told, kinds = [c for c in ("message", "metadata") if c in snapshots.columns], [c for c in ("mode",) if c in entries.columns]
    first = F.min(F.struct("created_at", *told)).alias("x")
    fresh = sync.new_arrivals(snapshots.groupBy(*source).agg(first).select(*source, "x.*"), mine)
    ordered = fresh.withColumn("order", F.struct("created_at", *source))
    first_id = _next(here.snapshots, "snapshot_id")
    named = content.numbered(ordered, "order", first_id, "snapshot_id").drop("order")
    headers = sync.chained(mine, named, first_id).withColumn("repository_id", F.lit(repository_id).cast("long"))

    rows = sync.acceptable(entries).join(headers.select(*source, "snapshot_id"), source)
    present = rows.where("status = 1")
    objects = content.get_or_create(here.objects, present.select("digest", "size"), _next(here.objects, "object_id"))
    if "fast_digest" in rows.columns:
        objects = _with_fast_digests(objects, here.objects, present)
    rows = rows.join(objects.select("digest", "object_id"), "digest", "left")
    rows = rows.select(F.lit(repository_id).cast("long").alias("repository_id"), "snapshot_id", "path", "status", F.when(F.col("status") == 1, F.col("object_id")).alias("object_id"), "mtime", paths.depth(F.col("path")).alias("depth"), *kinds)

    wanted = replicas.groupBy(F.col("store").alias("name")).agg(F.min("url").alias("url")).join(here.stores, "name", "left_anti")
    stores = here.stores.select("store_id", "name", "url").unionByName(content.numbered(wanted, "name", _next(here.stores, "store_id"), "store_id").select("store_id", "name", "url"))
    known = replicas.join(objects.select("digest", "object_id"), "digest").join(stores.select(F.col("name").alias("store"), "store_id"), "store")
    first = known.groupBy("object_id", "store_id").agg(F.min(F.struct("path", "encrypted")).alias("x")).select("object_id", "store_id", "x.path", "x.encrypted")
    first = first.join(here.replicas, ["object_id", "store_id"], "left_anti")

    columns = [c for c in here.snapshots.columns if c in headers.columns]
    return replace(
        here,
        snapshots=here.snapshots.unionByName(headers.select(*columns, *(c for c in told if c not in columns)), allowMissingColumns=True),
        entries=here.entries.select([c for c in here.entries.columns if c in rows.columns]).unionByName(rows, allowMissingColumns=True),
        cache=sync.merge_cache(here.cache, rows),
        objects=objects,
        stores=stores,
        replicas=here.replicas.select("object_id", "store_id", "path", "encrypted").unionByName(first),
    )


def _with_fast_digests(objects: DataFrame, before: DataFrame, arrived: DataFrame) -> DataFrame:
    """Adds fast_digest: what an object had, else what arrived with it."""
    had = before.select("object_id", F.col("fast_digest").alias("had")) if "fast_digest" in before.columns else None
    new = arrived.groupBy("digest").agg(F.min("fast_digest").alias("new"))
    rows = objects.join(new, "digest", "left")
    rows = rows.withColumn("had", F.lit(None).cast("long")) if had is None else rows.join(had, "object_id", "left")
    return rows.select("object_id", "digest", "size", F.coalesce("had", "new").alias("fast_digest"))


def pull_apply(here: Tables, there: Tables, repository_id: int, machine_id: int, cursor: int) -> Tables:
    """What is here after the peer's snapshots beyond a cursor are applied, their entries, objects and replicas with them.

    ``machine_id`` names the peer as their source, so a pull that is repeated changes nothing.
    """
    remote = state.after(there.snapshots.where(F.col("repository_id") == repository_id), cursor)
    provenance = [F.lit(machine_id).cast("long").alias("source_machine_id"), F.col("snapshot_id").alias("source_snapshot_id")]
    rows = sync.pull_rows(there.snapshots, there.entries, there.objects, repository_id, cursor)
    replicas = sync.pull_replicas(rows, there.objects, there.replicas, there.stores)
    whole = replicas.withColumnRenamed("store", "name").join(there.stores.select("name", "url", "store_id"), "name").join(there.objects.select("digest", "object_id"), "digest")
    whole = whole.join(there.replicas.select("object_id", "store_id", "path", "encrypted"), ["object_id", "store_id", "path"]).select("digest", F.col("name").alias("store"), "url", "path", "encrypted")
    return push_apply(here, repository_id, remote.select(*provenance, "created_at"), rows.select(*provenance, "path", "status", "digest", "size", "mtime"), whole)


def push_to_database(here: Tables, there: Tables, repository_id: int, cursor: int, first_id: int) -> Tables:
    """A peer's tables after its database is written to directly: every snapshot beyond the cursor arrives anew, with no
    provenance, and the peer's cache stays as it is; a push that is repeated adds its snapshots again."""
    fresh = state.after(here.snapshots.where(F.col("repository_id") == repository_id), cursor)
    arriving = fresh.select(F.col("snapshot_id").alias("source_snapshot_id"), "created_at")
    headers = sync.apply_pull(there.snapshots.where(F.col("repository_id") == repository_id), arriving, first_id)
    rows = sync.pull_rows(here.snapshots, here.entries, here.objects, repository_id, cursor)
    objects = content.get_or_create(there.objects, rows.where("status = 1 and digest is not null").select("digest", "size"), _next(there.objects, "object_id"))
    rows = rows.withColumnRenamed("snapshot_id", "source_snapshot_id").join(headers.select("source_snapshot_id", "snapshot_id"), "source_snapshot_id").join(objects.select("digest", "object_id"), "digest", "left")
    rows = rows.select(F.lit(repository_id).cast("long").alias("repository_id"), "snapshot_id", "path", "status", "object_id", "mtime", paths.depth(F.col("path")).alias("depth"))
    none = F.lit(None).cast("long")
    headers = headers.select("snapshot_id", F.lit(repository_id).cast("long").alias("repository_id"), "parent_id", "created_at", none.alias("source_machine_id"), none.alias("source_snapshot_id"))
    return replace(there, snapshots=there.snapshots.unionByName(headers.select(there.snapshots.columns)), entries=there.entries.select(rows.columns).unionByName(rows), objects=objects)


def pull_and_copy(here: Tables, there: Tables, repository_id: int, machine_id: int, cursor: int, source: int, target: int) -> tuple[Tables, DataFrame]:
    """A pull, and what the target store here then has to copy from the source store."""
    after = pull_apply(here, there, repository_id, machine_id, cursor)
    return after, content.copy_plan(after.replicas, after.objects, source, target)


def push_after_scan(here: Tables, there: Tables, repository_id: int, machine_id: int, cursor: int, store_id: int) -> tuple[Tables, DataFrame]:
    """What a store lacks of a repository's present files, and the peer's tables after the snapshots beyond the cursor are pushed."""
    plan = content.push_plan(here.cache, here.replicas, repository_id, store_id)
    pushed = plan.where("action = 'push'").join(here.objects, "object_id")
    added = pushed.select("object_id", F.lit(store_id).cast(here.replicas.schema["store_id"].dataType).alias("store_id"), paths.blob_path(F.col("digest")).alias("path"), F.lit(False).alias("encrypted"))
    with_blobs = replace(here, replicas=here.replicas.select(added.columns).unionByName(added))
    return pull_apply(there, with_blobs, repository_id, machine_id, cursor), plan
