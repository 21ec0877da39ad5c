"""A corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospark.llm import decontamination, line_dedup, packing, similar, toxicity
from chronospark.llm.common import remove, shared_folder, table
from chronospark.llm.queries import tokenizer_path


# All stages: columns that documents have beyond those used pass through (the last stage's columns are its own), whatever
# their names. An empty table gives an empty one. Rows are told by id and text, so that rows which share an id, or have none, are
# judged each by its own text.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, does not reject.

    Null and empty texts have no features and are scored like any other; rows that repeat get one decision; a score of just the
    threshold rejects. Without labels of both kinds nothing is known: all rows score the share of label 1. A very long text is one row.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of repeated three-line windows.

    Null stays null, and texts of fewer than three lines stay as they are. The first occurrence is that in the smallest document (null
    ids last, then by the text's hash). Rows that repeat are one document. n_chars follows the text.
    """
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    # The operator's own columns take the place of columns of their names; those come back from another name.
    own = {c: f"kept_{uuid.uuid4().hex}" for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    cleaned = line_dedup.dedup_lines(docs.withColumnsRenamed(own)).withColumn("n_chars", n_chars).drop("n_lines", "n_removed")
    return cleaned.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles of five words with a similarity of 0.8 or more the one with the smallest id.

    Texts without words, null included, are copies of each other. Null ids come last, ties go to the smaller hash of the text. Rows
    that repeat the one that stays, id and text, stay with it. Very long texts are compared as whole sets of shingles.
    """
    return similar.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an exact phrase of a benchmark item.

    Null and empty texts stay. Rows that repeat go or stay together. An empty benchmark drops nothing. Very long texts are compared whole.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token sequences.

    Null and empty texts are one token, the closing one. Rows that repeat, or have no id, are documents of their own. Very long texts
    fill many sequences.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written to the folder that the executors share, and removed when the
    next one is written; the last one's stays, as the result reads it."""
    folder, docs, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
