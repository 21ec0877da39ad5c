"""The folder that all executors share: checkpoints in it, and global row numbers that need them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the context's folder. Only a local session without either gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; its partitions keep their order from then on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row (from 1) in a total order.

    A range-partitioned sort, one count for each partition, and a sum over those counts: no task holds more than its own range.
    """
    rows = checkpointed(df.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    begun, starts = 0, []
    for p, n in counts:
        starts.append((p, begun))
        begun += n
    known = df.sparkSession.createDataFrame(starts, "__part long, __begun long")
    joined = rows.withColumn("__part", part).join(F.broadcast(known), "__part")
    return joined.select(*df.columns, (F.col("__begun") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
