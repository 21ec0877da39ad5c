"""Near-duplicate detection: 64-bit SimHash fingerprints linked through pivot distance tables.

Every distinct fingerprint is compared through a pivot distance table: its Hamming distances to fixed reference
fingerprints. By the triangle inequality, two fingerprints whose coordinates differ by more than the link radius
anywhere can't be linked; only pairs that pass every coordinate are verified bit by bit. To find each other without
all pairs, fingerprints meet in cells of their first coordinates: linked ones lie in the same cells or next to each other, and those
near an edge stand on both sides of it. More fingerprints take more coordinates. No link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, pick, without_rows
from .components import connected_components

SHINGLE = 3
RADIUS = 2
PIVOTS = 24
#: Width of a cell by radius + 1, and how many random fingerprints a cell holds about.
CELL, CROWD = 2, 256
#: A meeting place with more fingerprints than this is split into tiles of two parts of half that size.
TILE = 16_384
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints from a fixed generator, each second one the complement's neighbour of none."""
    return np.random.default_rng(64).integers(0, 2**64, n, dtype=np.uint64)


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text; zero if it has no words."""
    import xxhash

    if not text:
        return 0
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    step = 1 << 16
    for at in range(0, n, step):
        octets = hashes[at : at + step].astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
        ones += (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): one row per input row, th the text's xxhash64, fp as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x, shingle) for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "th", "fp"])

    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, fp long")


def pivot_pairs(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the same group within the radius. The rows must be sorted by group; the result's indices are theirs.

    Inside each group the rows are ordered by their distance to the last pivot, which keys no cell. A row is held against its next
    neighbours only until that coordinate differs by more than the radius.
    """
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int16)
    order = np.lexsort((table[:, -1], group))
    table, g, f = table[order], group[order], fps[order]
    first, active, left, right = np.ascontiguousarray(table[:, -1]), np.arange(len(f)), [], []
    step = 0
    while len(active):
        step += 1
        active = active[active + step < len(f)]
        active = active[(g[active] == g[active + step]) & (first[active + step] - first[active] <= radius)]
        for part in np.array_split(active, max(1, len(active) >> 16)):
            other = part + step
            near = (np.abs(table[part] - table[other]) <= radius).all(axis=1)
            a, b = part[near], other[near]
            close = np.bitwise_count(f[a] ^ f[b]) <= radius
            left.append(order[a[close]])
            right.append(order[b[close]])
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def cell_pivots(n: int) -> int:
    """How many pivots' distances key the cells of ``n`` fingerprints, so that random ones leave some CROWD in a cell."""
    return min(PIVOTS - 4, max(1, round(math.log(max(1, n) / CROWD) / math.log(2.5))))


def cells(fps: np.ndarray, n: int, width: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the cells in which fingerprints meet: the distances to ``n`` pivots, each divided by ``width``.

    A row stands in the cell of each distance, and in the next one if the distance is so near its edge that one larger by the
    radius is beyond. Of two rows within the radius, the one with the smaller distance to a pivot so shares the other's cell, and
    that holds for all pivots at once only if the choice is made for each of them: a row stands in every combination.
    """
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :n]).astype(np.uint64)
    own, keys = np.arange(len(fps)), np.zeros(len(fps), np.uint64)
    for p in range(n):
        low, high = table[own, p] // np.uint64(width), (table[own, p] + np.uint64(radius)) // np.uint64(width)
        more = np.flatnonzero(high > low)
        own, keys, cell = np.concatenate([own, own[more]]), np.concatenate([keys, keys[more]]), np.concatenate([low, high[more]])
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + cell + np.uint64(1)
    return own, keys


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the pairs connect it with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], least)
        np.minimum.at(new, root[right], least)
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        while (jump := new[new]).tolist() != new.tolist():
            new = jump
        if (new == root).all():
            return root
        root = new


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that connect the same fingerprints as all pairs within the radius do. ``fps``: distinct longs fp.

    What leaves a meeting place is a spanning forest of its links, not every pair: the rows stay in proportion to
    the fingerprints even within a group of many near copies.
    """
    bounded_batches(fps.sparkSession)
    n = cell_pivots(fps.count())
    width = CELL * (radius + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, keys = cells(b.column(0).to_numpy().view(np.uint64), n, width, radius)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(keys.view(np.int64))], names=["fp", "k"])

    placed = checkpointed(fps.mapInArrow(place, "fp long, k long"))
    crowds = placed.groupBy("k").count().where(F.col("count") > 1)
    parts = F.ceil(F.col("count") / F.lit(TILE // 2)).cast("int")
    met = placed.join(crowds, "k").withColumn("s", F.when(F.col("count") <= TILE, 1).otherwise(parts)).withColumn("a", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    # A crowd of s parts becomes tiles (i, j), i < j: each row goes to the s - 1 tiles that hold its part.
    others = F.when(F.col("s") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda x: x != F.col("a")))
    tiled = met.withColumn("b", F.explode(others)).select("k", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "fp")
    tiled = tiled.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")

    def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
        k, i, j, fp = np.concatenate(rows, axis=1)
        change = np.ones(len(k), dtype=bool)
        change[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        bits = fp.view(np.uint64)
        left, right = pivot_pairs(np.cumsum(change), bits, radius)
        root = forest(len(fp), left, right)
        moved = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)])
            if n >= TILE and len(cuts := np.flatnonzero((rows[:3] != np.concatenate([held[-1][:3, -1:], rows[:3, :-1]], axis=1)).any(axis=0))):
                yield flush([*held, rows[:, : cuts[0]]])
                held, n, rows = [], 0, rows[:, cuts[0] :]
            held.append(rows)
            n += rows.shape[1]
        if held:
            yield flush(held)

    return tiled.mapInArrow(run, "u long, v long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """(doc_id, th, fp, first): for each row the smallest (z, doc_id, th) of its component, z being 1 for a null id."""
    prints = checkpointed(with_fingerprints(docs, id_col, text_col, shingle))
    place = F.struct(F.col("doc_id").isNull().cast("int").alias("z"), "doc_id", "th")
    classes = checkpointed(prints.groupBy("fp").agg(F.min(place).alias("least")))
    comps = connected_components(links(classes.select("fp"), radius))
    rooted = classes.join(comps, classes.fp == comps.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return prints.join(rooted.join(named, "root").select("fp", "first"), "fp").select("doc_id", "th", "fp", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Null and empty texts and texts without words have fingerprint zero and are linked like any other. Rows that
    repeat are rows of one component. A null id gets its component's smallest id, or null if all of its ids are
    null. An empty table gives an empty table; other columns are ignored. Very long texts are counted in portions.
    """
    found = _grouped(docs, id_col, text_col, shingle, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document for each component: that with the smallest id (null last), then text hash.

    A document is an id and a text: rows that repeat both stay or go together. Of rows that share an id or have none each is judged by
    its text.
    """
    found = _grouped(docs, id_col, text_col, shingle, radius)
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).select("doc_id", "th").distinct()
    return without_rows(docs, gone, id_col, text_col)
