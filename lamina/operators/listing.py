"""Listings: logs, files, directories, pages, history and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, paths


def log(snapshots: DataFrame, counters: DataFrame, *, after: Column | None = None, before: Column | None = None, limit: int | None = None) -> DataFrame:
    """Snapshots newest first with a summary of their changes; both bounds are exclusive."""
    rows = snapshots if after is None else snapshots.where(F.col("created_at") > after)
    rows = rows if before is None else rows.where(F.col("created_at") < before)
    rows = rows.orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    rows = rows if limit is None else rows.limit(limit)
    summary = paths.change_summary(F.col("added"), F.col("modified"), F.col("deleted")).alias("summary")
    return rows.join(counters, ["repository_id", "snapshot_id"], "left").select("repository_id", "snapshot_id", "created_at", summary)


def show(entries: DataFrame, objects: DataFrame, snapshot_id: int) -> DataFrame:
    """A snapshot's rows with digest and size."""
    rows = entries.where(F.col("snapshot_id") == snapshot_id).join(objects, "object_id", "left")
    return rows.select("path", paths.status_label(F.col("status")).alias("state"), "object_id", paths.short_digest(F.col("digest")).alias("digest"), "size", "depth")


def files(cache: DataFrame, repository_id: int, prefix: str = "", *, wildcards: bool = False) -> DataFrame:
    """Present paths of a repository below a literal, case-sensitive prefix; ``wildcards``: % and _ in it stand for any text, any character."""
    fits = F.col("path").like(f"{prefix}%") if wildcards else F.col("path").startswith(prefix)
    return cache.where((F.col("repository_id") == repository_id) & (F.col("status") == 1) & fits)


def children(cache: DataFrame, repository_id: int, directory: str) -> DataFrame:
    """Present files right in a directory."""
    bare = directory.strip("/")
    prefix, depth = (f"{bare}/", bare.count("/") + 1) if bare else ("", 0)
    return files(cache, repository_id, prefix).where(F.col("depth") == depth)


def listed(cache: DataFrame, repository_id: int, *, prefix: str = "", directory: str | None = None) -> DataFrame:
    """``files`` below a prefix or ``children`` of a directory; both at once are an error."""
    if prefix and directory is not None:
        raise ValueError("a prefix and a directory exclude each other")
    return files(cache, repository_id, prefix) if directory is None else children(cache, repository_id, directory)


def subdirectories(cache: DataFrame, repository_id: int, directory: str) -> DataFrame:
    """(name, n_files): the directories right in a directory, from the deeper paths."""
    bare = directory.strip("/")
    prefix = f"{bare}/" if bare else ""
    rest = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    deeper = files(cache, repository_id, prefix).where(F.contains(rest, F.lit("/")))
    return deeper.groupBy(F.substring_index(rest, "/", 1).alias("name")).agg(F.count("*").alias("n_files"))


def page(rows: DataFrame, *, page: int = 1, per_page: int = 100, order: str = "path") -> DataFrame:
    """One page in path order, with the total and the number of pages; per_page is kept within 1 to 500."""
    size, at = max(1, min(500, per_page)), max(1, page)
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(order).offset((at - 1) * size).limit(size)
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    return cut.crossJoin(F.broadcast(total)).withColumn("pages", pages)  # one row


def path_history(entries: DataFrame, snapshots: DataFrame, objects: DataFrame, repository_id: int, path: str) -> DataFrame:
    """All rows of a path with their snapshots' times and digests; newest first is the caller's order."""
    rows = entries.where((F.col("repository_id") == repository_id) & (F.col("path") == path))
    rows = rows.join(snapshots.select("snapshot_id", "created_at"), "snapshot_id").join(objects, "object_id", "left")
    action = F.when(F.col("status") == 0, "D").when(F.col("change") == "added", "A").otherwise("M")
    return rows.select("snapshot_id", "created_at", action.alias("action"), "object_id", paths.short_digest(F.col("digest")).alias("digest"), "size")


def object_references(entries: DataFrame, snapshots: DataFrame, object_id: int) -> DataFrame:
    """Where a content was ever seen."""
    rows = entries.where(F.col("object_id") == object_id)
    return rows.join(snapshots.select("snapshot_id", "created_at"), "snapshot_id").select("repository_id", "snapshot_id", "created_at", "path", "status")


def by_hex_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """The object whose digest starts with a prefix, with the number of those that do: above 1 it is ambiguous.

    A range on the digest that holds the prefix reaches the scan.
    """
    found = objects
    if prefix:
        last = chr(ord(prefix[-1]) + 1)
        found = objects.where((F.col("digest") >= prefix) & (F.col("digest") < prefix[:-1] + last) & F.col("digest").startswith(prefix))
    return found.agg(F.count("*").alias("matches"), F.min("object_id").alias("object_id"), F.min("digest").alias("digest"))


def api_rows(cache: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows as an API shows them: ids as text, digests in hex, times in RFC 3339, is_directory where the cache has modes."""
    more = [(F.col("mode") == 0o040000).alias("is_directory")] if "mode" in cache.columns else []
    zoned = cache.schema["mtime"].dataType.typeName() == "timestamp"
    rows = cache.join(objects, "object_id", "left")
    return rows.select(
        F.col("repository_id").cast("string").alias("repository_id"),
        "path",
        F.col("snapshot_id").cast("string").alias("snapshot_id"),
        paths.status_label(F.col("status")).alias("status"),
        F.col("object_id").cast("string").alias("object_id"),
        "digest",
        "size",
        keys.rfc3339(F.col("mtime"), zoned=zoned).alias("mtime"),
        *more,
    )
