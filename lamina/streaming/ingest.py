"""Continuous ingestion: snapshots applied once, and a cache that follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import cache_table, sync
from ..scratch import exists


def snapshot_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New snapshot rows as files arrive; the query's checkpoint is the cursor."""
    return spark.readStream.schema(schema).parquet(path)


def cache_versions(base: str) -> Callable[[int], str]:
    return lambda k: f"{base}/v{k}"


def _predecessor(spark: SparkSession, path: str, epoch: int) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"batch {epoch} needs what earlier batches wrote to {path}")
    return path


def maintain_table(entries: DataFrame, base: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Keeps the newest row of every path in a table of ``cache_table``; a batch that is run again changes nothing."""
    writer = entries.writeStream.foreachBatch(lambda batch, epoch: cache_table.apply(batch, base, epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def maintain_cache(entries: DataFrame, base: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Keeps the newest row of every path in versions of a table, one per batch: a batch run again writes its own again.

    Version k + 1 is version k merged with batch k, so a failed batch leaves what readers see untouched. A batch after the first
    whose version is gone is an error. Each version is the whole cache; ``maintain_table`` writes what a batch brings.
    """
    at = cache_versions(base)

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(_predecessor(spark, at(epoch), epoch)) if epoch else batch.limit(0)
        sync.merge_cache(old, batch).write.mode("overwrite").parquet(at(epoch + 1))

    writer = entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_once(incoming: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends arriving snapshots that are not in the table, by provenance; what repeats, in or across batches, is dropped."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark, keys = batch.sparkSession, ["source_machine_id", "source_snapshot_id"]
        fresh = batch.dropDuplicates(keys)
        if epoch:
            _predecessor(spark, table, epoch)
        if exists(spark, table):
            fresh = sync.new_arrivals(fresh, spark.read.schema(batch.schema).parquet(table))
        fresh.write.mode("append").parquet(table)

    return incoming.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
