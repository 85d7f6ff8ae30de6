"""The driver's tables seen as a file history: a deterministic projection, and the same in SQL.

events become observations of paths (one user is one path, ``error`` means the path is gone), documents the
content-addressed objects behind them, labels tags, region stores, nation machines.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import paths
from .operators import changes, state


class Domain:
    """Domain tables over the Parquet files of a folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text", "lang", "source", F.sha2("text", 256).alias("digest"))

    @cached_property
    def objects(self) -> DataFrame:
        size = F.octet_length("text").cast("long")
        return self.documents.groupBy("digest").agg(F.min("doc_id").alias("object_id"), F.min(size).alias("size"))

    @cached_property
    def doc_object(self) -> DataFrame:
        return self.documents.select("doc_id", "digest").join(self.objects.select("digest", "object_id"), "digest").select("doc_id", "object_id")

    @cached_property
    def observations(self) -> DataFrame:
        docs = self.table("documents").agg(F.count("*").alias("n_docs"))
        user = F.col("user_id")
        doc = (F.floor("value").cast("long") % 4 + (user * 3) % 500) % F.col("n_docs")
        newest = Window.partitionBy("user_id", F.dayofyear("ts")).orderBy(F.desc("ts"), F.desc("event_id"))
        last = self.table("events").withColumn("rn", F.row_number().over(newest)).where("rn = 1").crossJoin(F.broadcast(docs))  # one row
        path = F.concat(F.lit("d"), (user % 10).cast("string"), F.lit("/s"), (user % 7).cast("string"), F.lit("/u"), user.cast("string"), F.lit(".dat"))
        rows = last.select(
            (user % 4).alias("repository_id"),
            ((user % 4) * 1000 + F.dayofyear("ts")).alias("snapshot_id"),
            path.alias("path"),
            F.when(F.col("event_type") == "error", 0).otherwise(1).alias("status"),
            doc.alias("doc_id"),
            F.col("ts").alias("mtime"),
        )
        return rows.join(self.doc_object, "doc_id").select("repository_id", "snapshot_id", "path", "status", F.when(F.col("status") == 1, F.col("object_id")).alias("object_id"), "mtime")

    @cached_property
    def snapshots(self) -> DataFrame:
        rows = self.observations.groupBy("snapshot_id", "repository_id").agg(F.max("mtime").alias("created_at"))
        return state.with_parents(rows)

    @cached_property
    def changes(self) -> DataFrame:
        return changes.classify(self.observations)

    @cached_property
    def entries(self) -> DataFrame:
        return changes.delta_entries(self.changes)

    @cached_property
    def cache(self) -> DataFrame:
        return state.latest(self.entries)

    @cached_property
    def stores(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("store_id"), F.col("r_name").alias("name"), F.concat(F.lit("s3://"), F.lower("r_name")).alias("url"))

    @cached_property
    def replicas(self) -> DataFrame:
        spread = self.objects.crossJoin(F.broadcast(self.stores.select("store_id")))  # the stores are a handful
        rows = spread.where((F.col("object_id") + 3 * F.col("store_id")) % 4 != 0)
        return rows.select("object_id", "store_id", paths.blob_path(F.col("digest")).alias("path"), (F.col("object_id") % 5 == 0).alias("encrypted"))

    @cached_property
    def tags(self) -> DataFrame:
        labels = self.table("labels").join(self.doc_object, "doc_id")
        pair = lambda c: F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))
        rows = labels.select("object_id", F.inline(F.array(pair("quality"), pair("toxic"))))
        return rows.groupBy("object_id", "key").agg(F.max("value").alias("value"))

    @cached_property
    def machines(self) -> DataFrame:
        return self.table("nation").select((F.col("n_nationkey") + 1).alias("machine_id"), F.col("n_name").alias("name"))

    @cached_property
    def sync_peers(self) -> DataFrame:
        repo = self.snapshots.select("repository_id").distinct()
        return repo.select("repository_id", F.concat(F.lit("peer"), F.col("repository_id").cast("string")).alias("name"), (F.col("repository_id") * 1000 + 20).alias("last_snapshot_id"))


#: The same projection in the SQL that Spark and DuckDB share, but for the digest and byte-length functions.
SQL_VIEWS = """
f_objects AS (
  SELECT min(doc_id) AS object_id, digest, min(size) AS size
  FROM (SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS size FROM documents) d GROUP BY digest),
f_doc_object AS (SELECT d.doc_id, o.object_id FROM documents d JOIN f_objects o ON sha256(d.text) = o.digest),
f_observations AS (
  SELECT e.repository_id, e.snapshot_id, e.path, e.status, CASE WHEN e.status = 1 THEN m.object_id END AS object_id, e.ts AS mtime
  FROM (SELECT user_id % 4 AS repository_id, (user_id % 4) * 1000 + dayofyear(ts) AS snapshot_id,
               concat('d', cast(user_id % 10 AS varchar(20)), '/s', cast(user_id % 7 AS varchar(20)), '/u', cast(user_id AS varchar(20)), '.dat') AS path,
               CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS status,
               (cast(floor(value) AS bigint) % 4 + (user_id * 3) % 500) % (SELECT count(*) FROM documents) AS doc_id, ts,
               row_number() OVER (PARTITION BY user_id, dayofyear(ts) ORDER BY ts DESC, event_id DESC) AS rn
        FROM events) e JOIN f_doc_object m ON e.doc_id = m.doc_id WHERE e.rn = 1),
f_snapshots AS (
  SELECT snapshot_id, repository_id, created_at, lag(snapshot_id) OVER (PARTITION BY repository_id ORDER BY created_at, snapshot_id) AS parent_id
  FROM (SELECT snapshot_id, repository_id, max(mtime) AS created_at FROM f_observations GROUP BY snapshot_id, repository_id) s),
f_changes AS (
  SELECT repository_id, snapshot_id, path, status, object_id, mtime,
         CASE WHEN status = 0 AND coalesce(p_status, 0) = 0 THEN 'noop' WHEN status = 0 THEN 'deleted' WHEN coalesce(p_status, 0) = 0 THEN 'added'
              WHEN object_id = p_object_id THEN 'unchanged' ELSE 'modified' END AS change
  FROM (SELECT o.*, lag(status) OVER (PARTITION BY repository_id, path ORDER BY snapshot_id) AS p_status,
               lag(object_id) OVER (PARTITION BY repository_id, path ORDER BY snapshot_id) AS p_object_id FROM f_observations o) x),
f_entries AS (
  SELECT repository_id, snapshot_id, path, status, object_id, mtime, length(path) - length(replace(path, '/', '')) AS depth, change
  FROM f_changes WHERE change IN ('added', 'modified', 'deleted')),
f_entry_cache AS (
  SELECT repository_id, path, snapshot_id, status, object_id, mtime, depth
  FROM (SELECT e.*, row_number() OVER (PARTITION BY repository_id, path ORDER BY snapshot_id DESC) AS rn FROM f_entries e) x WHERE rn = 1),
f_stores AS (SELECT cast(r_regionkey AS bigint) AS store_id, r_name AS name, concat('s3://', lower(r_name)) AS url FROM region),
f_replicas AS (
  SELECT o.object_id, s.store_id, concat('objects/', substring(o.digest, 1, 2), '/', substring(o.digest, 3, 2), '/', o.digest) AS path, o.object_id % 5 = 0 AS encrypted
  FROM f_objects o CROSS JOIN f_stores s WHERE (o.object_id + 3 * s.store_id) % 4 <> 0),
f_tags AS (
  SELECT object_id, key, max(value) AS value
  FROM (SELECT m.object_id, 'quality' AS key, cast(l.quality AS varchar(20)) AS value FROM labels l JOIN f_doc_object m ON l.doc_id = m.doc_id
        UNION ALL SELECT m.object_id, 'toxic' AS key, cast(l.toxic AS varchar(20)) AS value FROM labels l JOIN f_doc_object m ON l.doc_id = m.doc_id) t
  GROUP BY object_id, key),
f_machines AS (SELECT n_nationkey + 1 AS machine_id, n_name AS name FROM nation),
f_sync_peers AS (
  SELECT repository_id, concat('peer', cast(repository_id AS varchar(20))) AS name, repository_id * 1000 + 20 AS last_snapshot_id
  FROM (SELECT DISTINCT repository_id FROM f_snapshots) r)
"""


def sql(body: str, *more: str) -> str:
    """A query over the views, with further common table expressions of its own."""
    return "WITH " + ", ".join([SQL_VIEWS.strip(), *more]) + "\n" + body
