"""Intermediate tables that outlive executors: written once to the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; a session without one (tests) gets a temporary folder of its own."""
    path = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set(KEY, path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lamina-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a frame that reads it: lineage ends there."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that ``materialize`` returned and nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lamina-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store."""
    fs, at = _place(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder; nothing if it isn't there."""
    fs, at = _place(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all in it, if it is there."""
    fs, at = _place(spark, path)
    fs.delete(at, True)


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that is there wholly or not at all; FileExistsError if it is there already."""
    fs, at = _place(spark, path)
    _, draft = _place(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(path)


def mover(spark: SparkSession, folder: str) -> Callable[[str, str], None]:
    """A function that moves a file to a new name in ``folder``, in one step."""
    fs, at = _place(spark, folder)
    fs.mkdirs(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def move(source: str, name: str) -> None:
        if not fs.rename(path(source), path(f"{folder}/{name}")):
            raise FileNotFoundError(source)

    return move
