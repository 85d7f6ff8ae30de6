"""Objects, replicas, stores and tags: joins and set algebra on content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialize


def replicas_in_store(replicas: DataFrame, objects: DataFrame, store_id: int) -> DataFrame:
    return replicas.where(F.col("store_id") == store_id).join(objects, "object_id").select("object_id", "digest", "size", "path", "encrypted")


def replicas_with_stores(replicas: DataFrame, stores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Replicas, with their stores, of the wanted object_ids."""
    return replicas.join(wanted.select("object_id").distinct(), "object_id", "left_semi").join(stores, "store_id").select("object_id", "name", "url", "path", "encrypted")


def store_counts(replicas: DataFrame, stores: DataFrame) -> DataFrame:
    n = replicas.groupBy("store_id").agg(F.count("*").alias("n"))
    return stores.join(n, "store_id", "left").select("store_id", "name", F.coalesce("n", F.lit(0)).alias("n_replicas"))


def missing_in(replicas: DataFrame, objects: DataFrame, source: int, target: int) -> DataFrame:
    """Objects that one store has and another lacks."""
    of = lambda s: replicas.where(F.col("store_id") == s).select("object_id")
    return objects.join(of(source).join(of(target), "object_id", "left_anti"), "object_id", "left_semi")


def push_plan(cache: DataFrame, replicas: DataFrame, repository_id: int, store_id: int) -> DataFrame:
    """(path, object_id, action) for present paths: push the first path of each absent object, skip the rest."""
    present = cache.where((F.col("repository_id") == repository_id) & (F.col("status") == 1)).select("path", "object_id")
    there = replicas.where(F.col("store_id") == store_id).select("object_id", F.lit(True).alias("there"))
    first = present.groupBy("object_id").agg(F.min("path").alias("first"))
    rows = present.join(first, "object_id").join(there, "object_id", "left")
    action = F.when(F.col("there").isNull() & (F.col("path") == F.col("first")), "push").otherwise("skip")
    return rows.select("path", "object_id", action.alias("action"))


def copy_plan(replicas: DataFrame, objects: DataFrame, source: int, target: int) -> DataFrame:
    """(object_id, from_path, size, encrypted) of what a store has to get from another."""
    missing = missing_in(replicas, objects, source, target).select("object_id", "size")
    return missing.join(replicas.where(F.col("store_id") == source), "object_id").select("object_id", F.col("path").alias("from_path"), "size", "encrypted")


def restore_plan(present: DataFrame, replicas: DataFrame, stores: DataFrame, *, store_id: int | None = None, prefix: str = "") -> DataFrame:
    """(path, object_id, candidates, store, replica_path) per present path; without an unencrypted replica the last two are null."""
    usable = replicas.where(~F.col("encrypted"))
    usable = usable if store_id is None else usable.where(F.col("store_id") == store_id)
    named = usable.join(stores, "store_id").select("object_id", F.col("name").alias("store"), F.col("path").alias("replica_path"))
    best = named.groupBy("object_id").agg(F.count("*").alias("n"), F.min(F.struct("store", "replica_path")).alias("x"))
    rows = present.where(F.col("path").startswith(prefix)).join(best, "object_id", "left")
    return rows.select("path", "object_id", F.coalesce("n", F.lit(0)).alias("candidates"), "x.store", "x.replica_path")


def store_verify(replicas: DataFrame, objects: DataFrame, blobs: DataFrame) -> DataFrame:
    """(object_id, store_id, result) of replicas against blobs (store_id, path, blob_digest, blob_size): encrypted ones are skipped."""
    rows = replicas.join(objects, "object_id").join(blobs, ["store_id", "path"], "left")
    good = F.col("blob_digest").eqNullSafe(F.col("digest")) & F.col("blob_size").eqNullSafe(F.col("size"))
    result = F.when(F.col("encrypted"), "skipped").when(F.col("blob_digest").isNull(), "missing").when(good, "ok").otherwise("corrupt")
    return rows.select("object_id", "store_id", result.alias("result"))


def mark_verified(replicas: DataFrame, verified: DataFrame, moment: Column) -> DataFrame:
    """Replicas with verified_at: the moment for those that ``store_verify`` found good, for others what it was, null if never."""
    good = verified.where("result = 'ok'").select("object_id", "store_id", F.lit(True).alias("__good")).distinct()
    rows = replicas if "verified_at" in replicas.columns else replicas.withColumn("verified_at", F.lit(None).cast("timestamp"))
    rows = rows.join(good, ["object_id", "store_id"], "left")
    return rows.withColumn("verified_at", F.when(F.col("__good"), moment).otherwise(F.col("verified_at"))).drop("__good")


def tags_search(tags: DataFrame, objects: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Objects with a tag, with all tags of each as sorted ``key=value`` texts."""
    hit = tags.where(F.col("key") == key)
    hit = hit if value is None else hit.where(F.col("value") == value)
    mine = tags.join(hit.select("object_id").distinct(), "object_id", "left_semi")
    text = F.concat_ws("=", "key", F.coalesce("value", F.lit("")))
    return mine.groupBy("object_id").agg(F.array_sort(F.collect_list(text)).alias("tags")).join(objects, "object_id").select("object_id", "digest", "tags")


def tags_upsert(tags: DataFrame, changed: DataFrame) -> DataFrame:
    """Tags after setting ``changed`` (object_id, key, value; a null value is a value)."""
    return tags.join(changed, ["object_id", "key"], "left_anti").select("object_id", "key", "value").unionByName(changed.select("object_id", "key", "value"))


def tags_delete(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, ["object_id", "key"], "left_anti")


def duplicates(cache: DataFrame, objects: DataFrame) -> DataFrame:
    """Contents that several present paths hold, in any repository, with the bytes their copies waste."""
    n = cache.where("status = 1").groupBy("object_id").agg(F.count("*").alias("n_paths"), F.min("repository_id").alias("low"), F.max("repository_id").alias("high"), F.min("path").alias("first_path"))
    rows = n.where("n_paths > 1").join(objects, "object_id")
    return rows.select("object_id", "n_paths", (F.col("low") < F.col("high")).alias("across"), "first_path", "size", ((F.col("n_paths") - 1) * F.col("size")).alias("wasted"))


def unreferenced(objects: DataFrame, entries: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Objects that no entry, and no snapshot's tree root, refers to."""
    used = entries.select("object_id").where("object_id is not null")
    used = used if roots is None else used.union(roots.select("object_id").where("object_id is not null"))
    return objects.join(used.distinct(), "object_id", "left_anti")


def get_or_create(objects: DataFrame, incoming: DataFrame, next_id: int) -> DataFrame:
    """Objects with those of ``incoming`` (digest, size) that are new; new ids ascend with the digest."""
    fresh = incoming.groupBy("digest").agg(F.min("size").alias("size")).join(objects, "digest", "left_anti")
    return objects.select("object_id", "digest", "size").union(numbered(fresh, "digest", next_id, "object_id").select("object_id", "digest", "size"))


def numbered(rows: DataFrame, order: str, first: int, name: str) -> DataFrame:
    """Adds consecutive ids in the order of a column: ranges are sorted apart, their sizes summed, so no task sees all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(rows.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()), "ranges")
    local = parts.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    sizes = local.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))  # a row for each part
    return local.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, first + F.col("__before") + F.col("__rn") - 1).drop("__part", "__rn", "__before")


def next_id(machines: DataFrame, column: str = "machine_id") -> DataFrame:
    return machines.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def json_get(config: Column, key: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(config, f"$.{key}"), F.lit(default))


def json_set(config: Column, key: str, value: Column) -> Column:
    """A flat JSON object of texts with one key set; null removes it."""
    old = F.map_filter(F.coalesce(F.from_json(config, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.to_json(F.when(value.isNull(), old).otherwise(F.map_concat(old, F.create_map(F.lit(key), value))))
