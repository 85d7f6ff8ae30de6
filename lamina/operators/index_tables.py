"""Index tables: rows stored in the order of a key, one table for each way they are looked up, read in pages.

A table is range-partitioned and sorted by (pk, sk), so a key's rows lie in few files and row groups, and conditions on
both columns reach the scan. A page ends with a token that the next one begins behind.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys

#: Bytes of a row group: a page reads one or two.
ROW_GROUP = 4 << 20


def write(rows: DataFrame, path: str, pk: Column, sk: Column, *, parts: int | None = None) -> None:
    """``rows`` with pk and sk, in their order. Rows whose key is null can't be found and are left out; (pk, sk) names one row."""
    keyed = rows.select(pk.cast("string").alias("pk"), sk.cast("string").alias("sk"), *(c for c in rows.columns if c not in ("pk", "sk")))
    keyed = keyed.where("pk is not null and sk is not null")
    keyed = keyed.repartitionByRange("pk", "sk") if parts is None else keyed.repartitionByRange(parts, "pk", "sk")
    keyed.sortWithinPartitions("pk", "sk").write.option("parquet.block.size", ROW_GROUP).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def token(pk: str, sk: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([pk, sk]).encode()).decode()


def after(text: str, pk: str) -> str:
    """The sort key in a token; an error if it belongs to another partition key or is none."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text.encode()))
    except ValueError:
        raise ValueError("not a page token") from None
    if not isinstance(found, list) or len(found) != 2 or found[0] != pk:
        raise ValueError("the page token belongs to another key")
    return found[1]


def page(table: DataFrame, pk: str, *, begins_with: str = "", start: str | None = None, limit: int = 100) -> tuple[list, str | None]:
    """(rows, token of the next page or None): at most ``limit`` rows of a partition key, in the order of their sort keys.

    One row more is read than returned, so the last page says that it is the last.
    """
    found = keys.query(table, pk, begins_with=begins_with, after=None if start is None else after(start, pk), limit=limit + 1).collect()
    rows = found[:limit]
    return rows, token(pk, rows[-1]["sk"]) if len(found) > limit else None


def pages(table: DataFrame, pk: str, *, begins_with: str = "", limit: int = 100) -> DataFrame:
    """All rows that ``page`` gives when its tokens are followed to the end, with the number of their page, from 0. ``table`` is one that ``read`` gave.

    A file holds its rows in their order and no file reaches into another's range, so a row's place is that in its file, behind what
    the files before it hold: one pass over the range for the files, a row each, and one for the rows; nothing is sorted or collected.
    """
    rows = table.where((F.col("pk") == pk) & F.col("sk").startswith(begins_with))
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = rows.groupBy("__file").agg(F.min("sk").alias("__sk"), F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.orderBy("__sk").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__file", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    placed = rows.join(F.broadcast(files), "__file")  # a row for each file
    return placed.withColumn("page", F.floor((F.col("__at") + F.col("__shift")) / limit)).drop("__file", "__at", "__shift")


def cached_paths(cache: DataFrame, path: str) -> None:
    """The newest row of each path, by repository and path."""
    write(cache, path, keys.named(keys.REPO, F.col("repository_id")), keys.named(keys.CACHE, F.col("path")))


def histories(entries: DataFrame, path: str) -> None:
    """All rows of a path, by repository and path, then snapshot."""
    write(entries, path, keys.of_path(F.col("repository_id").cast("string"), F.col("path")), keys.paths.padded_id(F.col("snapshot_id")))


def by_snapshot(snapshots: DataFrame, path: str) -> None:
    """Snapshots by repository, then id."""
    write(snapshots, path, keys.named(keys.REPO, F.col("repository_id")), keys.numbered(keys.SNAP, F.col("snapshot_id")))


def by_source(snapshots: DataFrame, path: str) -> None:
    """Snapshots (repository_id, source_machine_id, source_snapshot_id) that machines have pushed, by repository and machine; others are left out."""
    write(snapshots, path, keys.of_source(F.col("repository_id").cast("string"), F.col("source_machine_id")), keys.paths.padded_id(F.col("source_snapshot_id")))
