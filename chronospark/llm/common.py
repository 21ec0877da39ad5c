"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Arrow batches that carry texts are held to this size, so that a run of very long texts can't fill a worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Before a Python stage: the executors get this package, and Arrow batches are kept small in bytes and in rows."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, 2001):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    now = re.fullmatch(r"(\d+)b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between stages.

    ``spark.checkpoint.dir`` is read from the session. Only where neither it nor a folder of the context is
    set (tests, a local shell) does this choose a temporary one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def _free(spark: SparkSession) -> None:
    """Shuffle files of steps that nothing refers to any more go once both collectors have run."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder that this project has written, wherever Spark's file systems reach."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables between the steps of one call, compressed and by column in the shared folder. ``drop`` removes those that are done with."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        del df
        _free(self.spark)
        return out

    def drop(self, *numbers: int) -> None:
        """Remove the tables of these numbers, counted from 1 in the order in which they were written."""
        for n in numbers:
            remove(self.spark, f"{self.folder}/{n}")


def lower_ascii(col):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns of the input can't clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and text are not among ``gone`` (doc_id, th: the text's xxhash64); a null id equals a null id."""
    i, t = fresh(docs, "gone_id", "gone_th")
    out = gone.select(F.col("doc_id").alias(i), F.col("th").alias(t))
    return docs.join(out, docs[id_col].cast("long").eqNullSafe(out[i]) & (F.xxhash64(docs[text_col]) == out[t]), "left_anti")
