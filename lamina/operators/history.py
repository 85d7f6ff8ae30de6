"""Trees of whole states over all snapshots of a history, kept up incrementally.

A directory changes only where something below it does. So each directory has versions, one for each such snapshot, and a version's digest
is that of what its children are then: level by level, bottom-up, each child's version holds for the directory's versions
from its own to the child's next. What does not change is not hashed again; only names and digests move.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..scratch import materialize
from . import tree

KEY = ["repository_id", "path"]


def directory_versions(entries: DataFrame, objects: DataFrame, *, depth: int | None = None, digest: Callable[[], Column] = tree.native_digest) -> DataFrame:
    """(repository_id, path, snapshot_id, digest) of every directory at every snapshot that changes something below it.

    ``entries``: (repository_id, snapshot_id, path, status, object_id), at most one row for a path and snapshot, ids of a repository
    ascending with time; ``objects``: (object_id, digest as binary). digest is null where the directory is empty from then on; the
    root is the path ''. A row whose object is missing is an error. Each level is written once.
    """
    deepest = (entries.agg(F.max(paths.depth(F.col("path")))).first()[0] or 0) if depth is None else depth
    none = F.lit(None).cast("binary")
    rows = entries.select(*KEY, "snapshot_id", "status", "object_id").join(objects.select("object_id", F.col("digest").alias("__digest")), "object_id", "left")
    missing = F.raise_error(F.concat(F.lit("no object for "), "path")).cast("binary")
    value = F.when(F.col("status") == 0, none).when(F.col("__digest").isNull(), missing).otherwise(F.col("__digest"))
    files = materialize(rows.select(*KEY, F.lit("F").alias("kind"), "snapshot_id", value.alias("digest"), paths.depth(F.col("path")).alias("d")), "files")
    found, dirs = [], None
    for d in range(deepest, -1, -1):
        here = files.where(F.col("d") == d).drop("d")
        dirs = materialize(_level(here if dirs is None else here.unionByName(dirs), digest), "versions")
        found.append(dirs)
    return reduce(DataFrame.unionByName, found).drop("kind")


def _level(children: DataFrame, digest: Callable[[], Column]) -> DataFrame:
    """Versions of the directories that hold ``children`` (repository_id, path, kind, snapshot_id, digest)."""
    follows = F.lead("snapshot_id").over(Window.partitionBy(*KEY).orderBy("snapshot_id"))
    rows = children.withColumn("next", follows).withColumn("parent", paths.parent(F.col("path"))).withColumn("name", paths.basename(F.col("path")))
    place = ["repository_id", "parent"]
    # A row for each version of a directory; their number is that of the snapshots at most.
    versions = rows.select(*place, "snapshot_id").distinct().withColumn("i", F.row_number().over(Window.partitionBy(*place).orderBy("snapshot_id")))
    ends = versions.groupBy(*place).agg((F.max("i") + 1).alias("end"))
    spans = rows.where("digest is not null").join(versions, [*place, "snapshot_id"]).join(versions.select(*place, F.col("snapshot_id").alias("next"), F.col("i").alias("j")), [*place, "next"], "left").join(ends, place)
    held = spans.select(*place, "kind", "name", "digest", F.explode(F.sequence("i", F.coalesce("j", "end") - 1)).alias("i"))
    hashed = held.withColumn("mode", F.when(F.col("kind") == "D", tree.FOLDER).otherwise(tree.PLAIN)).groupBy(*place, "i").agg(digest().alias("digest"))
    return versions.join(hashed, [*place, "i"], "left").select("repository_id", F.col("parent").alias("path"), F.lit("D").alias("kind"), "snapshot_id", "digest")


def state_roots(snapshots: DataFrame, versions: DataFrame) -> DataFrame:
    """(snapshot_id, root, n_hashed): the root of each snapshot's whole state, null where nothing is there, and how many directories
    it made anew. A snapshot that changes nothing has the root of the one before."""
    own = versions.groupBy("repository_id", "snapshot_id").agg(F.count("*").alias("n_hashed"), F.max(F.when(F.col("path") == "", F.struct(F.lit(1).alias("one"), "digest"))).alias("at"))
    rows = snapshots.select("repository_id", "snapshot_id").join(own, ["repository_id", "snapshot_id"], "left")
    upto = Window.partitionBy("repository_id").orderBy("snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("snapshot_id", F.last("at", ignorenulls=True).over(upto)["digest"].alias("root"), F.coalesce("n_hashed", F.lit(0)).alias("n_hashed"))
