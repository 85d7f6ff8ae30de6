"""The corpus pipeline: raw documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes what a stage
returns as Parquet in the shared folder and reads it again for the next. All stages but the last return
the columns of ``documents``. Empty tables pass through every stage; nulls and repeated rows are treated as
each operator's docstring says.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, packing, pii, quality_rules, similar
from lamina.scratch import discard, materialize

#: The setting that holds the key of the pseudonyms, so that runs agree; without it each run draws a key that nobody keeps.
KEY = "spark.lamina.pseudonyms.secret"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, with cutoffs from the labels, keep."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest doc_id."""
    return similar.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data under pseudonyms with the session's key, or one of this run alone; n_chars follows the text."""
    out = pii.pseudonymize(docs, key=spark.conf.get(KEY, None) or secrets.token_hex(32))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("personal data", privacy), ("packing", pack)]
#: SimHash, the binomial bounds and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents in ``sf_dir``. Each stage's table is deleted when the next one's is written; the last
    one stays, since the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
