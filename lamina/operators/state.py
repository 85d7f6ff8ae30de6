"""Point-in-time state from delta entries, and ways to name a snapshot."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("repository_id", "path")


def latest(entries: DataFrame) -> DataFrame:
    """The newest entry of every path, deleted ones too: the cache. A maximum, so each task sends one row per path."""
    rest = [c for c in entries.columns if c not in (*KEYS, "change")]
    best = F.max_by(F.struct(*rest), "snapshot_id").alias("x")
    return entries.groupBy(*KEYS).agg(best).select(*KEYS, *(F.col(f"x.{c}").alias(c) for c in rest))


def as_of(entries: DataFrame, snapshot_id: int) -> DataFrame:
    """Present paths of a snapshot's repository as they were at that snapshot; ids of a repository ascend with time."""
    repo = entries.where(F.col("snapshot_id") == snapshot_id).select("repository_id").distinct()
    return latest(entries.where(F.col("snapshot_id") <= snapshot_id).join(repo, "repository_id", "left_semi")).where("status = 1")


def as_of_in(entries: DataFrame, repository_id: int, snapshot_id: int) -> DataFrame:
    """``as_of`` where the repository is known: both conditions reach the scan."""
    return latest(entries.where((F.col("repository_id") == repository_id) & (F.col("snapshot_id") <= snapshot_id))).where("status = 1")


def with_parents(snapshots: DataFrame) -> DataFrame:
    """Adds parent_id: the snapshot before it in its repository."""
    return snapshots.withColumn("parent_id", F.lag("snapshot_id").over(Window.partitionBy("repository_id").orderBy("created_at", "snapshot_id")))


def nth_latest(snapshots: DataFrame, n: int) -> DataFrame:
    """@latest~n of every repository."""
    by = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    return snapshots.withColumn("rn", F.row_number().over(by)).where(F.col("rn") == n + 1).drop("rn")


def last_before(snapshots: DataFrame, moment: Column) -> DataFrame:
    """The newest snapshot of every repository at or before a moment."""
    best = F.max_by(F.struct("snapshot_id", "created_at"), F.struct("created_at", "snapshot_id")).alias("x")
    return snapshots.where(F.col("created_at") <= moment).groupBy("repository_id").agg(best).select("repository_id", "x.snapshot_id", "x.created_at")


def as_of_many(snapshots: DataFrame, probes: DataFrame, *, moment: str = "moment", slot: str = "1 day") -> DataFrame:
    """``probes`` (repository_id, a moment, others) with snapshot_id: the newest snapshot of the repository at or before the moment.

    Of snapshots of one moment the largest id; null before the first one, for a null moment and for a repository without any.
    Snapshots and probes are sorted together, and the last snapshot is carried over the probes that follow it: no range join.
    A repository is dealt out by slots of time, each of which begins with what the slots before it end with, so a large one
    is not one task. Repeated probes stay.
    """
    micros = probes.sparkSession.sql(f"SELECT unix_micros(timestamp '1970-01-01 00:00:00' + interval {slot}) - unix_micros(timestamp '1970-01-01 00:00:00') AS n").first()["n"]
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = F.lit(None)
    known = snapshots.select("repository_id", at("created_at").alias("__at"), F.col("snapshot_id").alias("__id"), none.cast(probes.schema).alias("__probe"))
    asked = probes.select("repository_id", at(moment).alias("__at"), none.cast("long").alias("__id"), F.struct(*probes.columns).alias("__probe"))
    rows = known.union(asked).withColumn("__slot", F.floor(F.col("__at") / micros))
    newest = F.when(F.col("__id").isNotNull(), F.struct("__at", "__id"))
    slots = rows.groupBy("repository_id", "__slot").agg(F.max(newest).alias("__last"))
    before = Window.partitionBy("repository_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("repository_id", "__slot", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    within = Window.partitionBy("repository_id", "__slot").orderBy("__at", F.col("__probe").isNotNull(), "__id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__here", F.last(newest, ignorenulls=True).over(within)).where("__probe is not null")
    same = rows["repository_id"].eqNullSafe(slots["repository_id"]) & rows["__slot"].eqNullSafe(slots["__slot"])
    found = rows.join(slots, same).select("__probe", F.coalesce("__here", "__carried")["__id"].alias("__found"))
    return found.select("__probe.*", F.col("__found").alias("snapshot_id"))


def after(snapshots: DataFrame, snapshot_id: int) -> DataFrame:
    """Snapshots created after the given one; all of them if it doesn't exist. ``in_order`` sorts them, the oldest first."""
    mark = snapshots.where(F.col("snapshot_id") == snapshot_id).agg(F.max("created_at").alias("mark"))
    return snapshots.crossJoin(F.broadcast(mark)).where(F.coalesce(F.col("created_at") > F.col("mark"), F.lit(True))).drop("mark")  # one row


def in_order(snapshots: DataFrame) -> DataFrame:
    """The oldest first, ties by id: the order in which snapshots after a cursor are sent and applied."""
    return snapshots.orderBy("created_at", "snapshot_id")


def parse_ref(text: str) -> tuple[str, int | datetime]:
    """('latest', n), ('before', moment) or ('id', n) of ``@latest``, ``@latest~N``, ``@2024-01-31``, ``@2024-01-31T10:30`` or a raw id."""
    if m := re.fullmatch(r"@latest(?:~(\d+))?", text):
        return "latest", int(m[1] or 0)
    if m := re.fullmatch(r"@(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}))?", text):
        return "before", datetime.fromisoformat(f"{m[1]} {m[2] + ':00' if m[2] else '23:59:59'}")
    if re.fullmatch(r"\d+", text):
        return "id", int(text)
    raise ValueError(f"not a snapshot: {text!r}")


def resolve(snapshots: DataFrame, text: str) -> DataFrame:
    """(repository_id, snapshot_id) that a reference names, in every repository; a raw id is not checked against one."""
    kind, value = parse_ref(text)
    if kind == "latest":
        found = nth_latest(snapshots, value)
    elif kind == "before":
        found = last_before(snapshots, F.lit(value).cast(snapshots.schema["created_at"].dataType))
    else:
        found = snapshots.where(F.col("snapshot_id") == value)
    return found.select("repository_id", "snapshot_id")
