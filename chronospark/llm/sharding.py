"""Sharding by sampled splitters.

Keys are (hash of the text, id): equal texts are neighbours, and a text that holds a large share of all rows is cut
by id. A size-weighted sample of keys gives quantile boundaries of many narrow ranges; overfull ranges are divided
again from a sample of their own. Exact sizes and counts of the ranges then give every row its place in the whole
order, and shards are equal shares of that order by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, checkpointed, fresh, pick

SHARDS = 40
ROW_BYTES = 16
#: Narrow ranges for each shard, and sampled keys for each range: they bound what the driver holds.
RANGES, SAMPLES = 32, 12
#: A group of equal texts stays whole up to this part of a shard.
WHOLE = 0.01


def _splitters(rows: DataFrame, ranges: int, total: int) -> list[tuple[int, int]]:
    """Quantile keys of a sample in which each row stands with a chance in proportion to its size, but at most 1."""
    chance = F.least(F.lit(1.0), F.col("size") * (ranges * SAMPLES / max(1, total)))
    drawn = F.pmod(F.xxhash64(F.lit("draw"), "h", "k"), F.lit(1 << 52)) / float(1 << 52)
    scale = ranges * SAMPLES / max(1, total)
    # Rows of one key are drawn together: they come as one, with their weights' sum.
    sample = rows.where(drawn < chance).groupBy("h", "k").agg(F.sum(F.greatest(F.lit(1.0), F.col("size") * scale)).alias("w"))
    keys = sorted((r["h"], r["k"], r["w"]) for r in sample.collect())
    if not keys:
        return []
    weight = np.cumsum([k[2] for k in keys])
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return sorted({keys[i][:2] for i in cuts})


def _ranged(rows: DataFrame, splitters: list[tuple[int, int]], name: str) -> DataFrame:
    """The number of splitters that are not greater than a row's key, as column ``name``."""
    heads = np.array([h for h, _ in splitters], dtype=np.int64)
    tails = np.array([k for _, k in splitters], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, k = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "k"))
            low, high = np.searchsorted(heads, h, "left"), np.searchsorted(heads, h, "right")
            tied = np.flatnonzero(low < high)
            at = low.copy()
            for a, z in {*zip(low[tied].tolist(), high[tied].tolist(), strict=True)}:
                own = tied[(low[tied] == a) & (high[tied] == z)]
                at[own] = a + np.searchsorted(tails[a:z], k[own], "right")
            yield b.append_column(name, pa.array(at.astype(np.int32)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {name} int")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, ranges: int = RANGES, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null), and ``row`` with ``row_col``.

    A row's size is its text's UTF-8 bytes plus 16; null is no text. Shards are consecutive shares of the key order
    with nearly equal sizes. Rows of equal texts are in one shard, unless they take more than a hundredth of one: those are
    shared out by id. Rows that repeat are neighbours with slots of their own; a null id comes first among
    equal texts. An empty table gives an empty table; other columns are ignored. A very long text is one row and fills its shard by
    itself, if need be. ``row_col`` names a column of longs that tells rows apart which share id and text.
    """
    bounded_batches(docs.sparkSession)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    extra = ["row"] if row_col else []
    rows = pick(docs, doc_id=id_col, text=text_col, **({"row": row_col} if row_col else {})).select(*extra, F.col("doc_id").cast("long"), (F.octet_length(data) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"))
    rows = checkpointed(rows)
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    n = n_shards * ranges
    first = _splitters(rows, n, total)
    ranged = _ranged(rows, first, "r")
    # Ranges of more than twice their share are divided by splitters from themselves alone.
    sizes = checkpointed(ranged.groupBy("r").agg(F.sum("size").alias("s"), F.count("*").alias("c")))
    over = sizes.where(F.col("s") > 2 * total / n).select("r")
    crowded = ranged.join(F.broadcast(over), "r").drop("r")  # at most n rows
    more = _splitters(crowded, n, total) if over.limit(1).count() else []
    ranged = checkpointed(_ranged(rows, sorted({*first, *more}), "r"))

    order = Window.partitionBy("r").orderBy("h", "k", "text_crc32", *extra)
    inside = ranged.select(*extra, "doc_id", "size", "text_crc32", "h", "r", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("b"), (F.row_number().over(order) - 1).alias("c"))
    per = ranged.groupBy("r").agg(F.sum("size").alias("s"), F.count("*").alias("c"))  # at most some 2n rows
    line = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    begun = per.select("r", F.coalesce(F.sum("s").over(line), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(line), F.lit(0)).alias("c0"))
    placed = inside.join(F.broadcast(begun), "r").select(*extra, "doc_id", "size", "text_crc32", "h", (F.coalesce("b", F.lit(0)) + F.col("b0")).alias("b"), (F.col("c") + F.col("c0")).alias("c"))
    # A group goes where its middle lies. Its rows are joined to it; groups of one row need no join. The checkpoint lets
    # the join deal out a hash with many rows by itself.
    groups = placed.groupBy("h").agg(F.count("*").alias("n"), F.min("b").alias("gb"), F.sum("size").alias("gs")).where(F.col("n") > 1).where(F.col("gs") <= WHOLE * total / n_shards).select("h", (F.col("gb") + F.col("gs") / 2).alias("middle"))
    groups = checkpointed(groups)
    own = F.col("b") + F.col("size") / 2
    middle = placed.join(groups, "h", "left").select(*extra, "doc_id", "size", "text_crc32", "c", F.coalesce("middle", own).alias("m"))
    shard = F.least(F.lit(n_shards - 1), F.floor(F.col("m") * n_shards / F.lit(max(1, total)))).cast("int")
    dealt = middle.select(*extra, "doc_id", "size", "text_crc32", "c", shard.alias("shard"))
    starts = dealt.groupBy("shard").agg(F.min("c").alias("c0"))  # one row a shard
    return dealt.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("c") - F.col("c0")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *extra)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Write all columns of ``docs`` under ``path``/shard=N, and return the table of places.

    Each row is written once, whether ids are distinct or not: rows are numbered in a table in the shared folder first, which is removed
    at the end. Columns of any name pass through, but for an input column of the name shard, which the folder's replaces.
    """
    scratch = Scratch(docs.sparkSession)
    number, own = fresh(docs, "row_number", "row_place")
    kept = [c for c in docs.columns if c.lower() != "shard"]
    rows = scratch.table(docs.withColumn(number, F.monotonically_increasing_id()))
    placed = checkpointed(shards(rows, id_col, text_col, row_col=number, **params))
    where = placed.select(F.col("row").alias(own), F.col("shard").alias("__shard_of_row"))
    whole = rows.join(where, rows[number] == where[own])
    whole.select(*[rows[c] for c in kept], F.col("__shard_of_row").alias("shard")).write.partitionBy("shard").mode("errorifexists").parquet(path)
    scratch.drop(1)
    return placed.drop("row")
