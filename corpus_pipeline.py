"""A pipeline over ``documents``: language ID, near-duplicate removal, removal of repeated passages, redaction of secrets, packing.

Each stage's result is written as Parquet in the folder that driver and executors share and read again as the next one's
input, so a lost executor costs no more than its part of one stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import langid, near_copies, packing, secrets, suffix_dedup
from tessella.llm.graph import ensure_checkpoint_dir
from tessella.llm.queries import TOKENIZER

Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near enough to a centroid of some language stay; null texts and texts without a letter go, repeated rows are judged each for itself."""
    return langid.accepted(docs, langid.fit(docs.where(~langid.held_out("doc_id"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id; nulls come last, ties go by hashes of text and row."""
    return near_copies.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document, or the same one earlier, has already are cut; emptied documents go."""
    return suffix_dedup.cut_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, null and empty texts and repeated rows as they are. Each text is searched whole, in one task."""
    return secrets.redact(docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null or empty text is its end mark alone, repeated rows are packed each for itself, no documents give no rows."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[Stage] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("packing", packing_plan),
]

#: SQL cannot express trained centroids or column generation.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage gives for the whole ``documents`` table.

    A stage's folder goes once the next one is written; the last one, which the result is read from, stays below the checkpoint folder.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
