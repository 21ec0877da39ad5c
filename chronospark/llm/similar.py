"""Near copies by the Jaccard similarity of word shingles, proposed by SimHash fingerprints and verified exactly.

A text is the set of its shingles (64-bit hashes). Its fingerprint is the bitwise majority of the set. At the radius that
a similarity of 0.8 needs, blocks of equal bits no longer bring fingerprints together, so they meet in places keyed by
bands of MinHash values. There, pairs that the pivot distance table or the sizes of the sets rule out are discarded. The
rest connects texts into candidate groups; inside a group every pair left is verified on the whole sets before it links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, pick, without_rows
from .components import connected_components
from .simhash import _BITS, forest, pivot_pairs

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 22
#: A pair of similarity s meets in no band with probability (1 - s ** ROWS) ** BANDS: 7e-6 at 0.8.
BANDS, ROWS = 30, 5
#: Places and groups beyond this weight (rows, or shingles) are split into tiles of two parts of half that weight.
TILE_ROWS = 4096
TILE_SHINGLES = 400_000
_RANDOM = np.random.default_rng(5)
_A = _RANDOM.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MIX = _RANDOM.integers(0, 2**63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of a shorter text, of all its words together; none without words."""
    import xxhash

    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype=np.uint64, count=max(1, len(words) - shingle + 1)))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
        ones += (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of the places where a set meets others."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, (short[None, at : at + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _MIX[:, ROWS]
    return keys ^ (keys >> np.uint64(29))


def name_of(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 7)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, h, n, fp, bands) of (doc_id, text, th): the name and the size of each row's set, its fingerprint and its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x) for x in b.column(1).cast(pa.binary()).to_pylist()]
            keys = pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _longs([name_of(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), _longs([majority(s) for s in sets]), keys], names=["doc_id", "th", "h", "n", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id long, th long, h long, n long, fp long, bands array<long>")


def tiled(rows: DataFrame, key: str, weight: Column, limit: int) -> DataFrame:
    """The rows of every key with more than one, with the tile (i, j) as further columns, dealt out and sorted by key and tile."""
    crowds = rows.groupBy(key).agg(F.count("*").alias("__rows"), F.sum(weight).alias("__weight")).where("__rows > 1")
    parts = F.when(F.col("__weight") <= limit, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("__weight") / F.lit(max(1, limit // 2))).cast("int")))
    met = rows.join(crowds, key).withColumn("__s", parts).withColumn("__a", F.pmod(F.xxhash64("h"), F.col("__s")).cast("int"))
    others = F.when(F.col("__s") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("__s") - 1), lambda x: x != F.col("__a")))
    out = met.withColumn("__b", F.explode(others)).withColumn("i", F.least("__a", "__b")).withColumn("j", F.greatest("__a", "__b"))
    return out.select(key, "i", "j", *[c for c in rows.columns if c != key]).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """The sorted rows in tables that end where a group (the first three columns) ends, of ``least`` rows or one group at least."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
        before = keys[:, :1] if last is None else last
        starts = np.flatnonzero((keys != np.concatenate([before, keys[:, :-1]], axis=1)).any(axis=0))
        at = 0
        for cut in starts.tolist():
            if n + cut - at >= least:
                yield pa.Table.from_batches([*held, b.slice(at, cut - at)])
                held, n, at = [], 0, cut
        held.append(b.slice(at))
        n += b.num_rows - at
        last = keys[:, -1:]
    if held:
        yield pa.Table.from_batches(held)


def close_pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group that neither the fingerprints nor the sizes of the sets rule out."""
    keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in range(3)])
    change = np.ones(rows.num_rows, dtype=bool)
    change[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    n = rows.column("n").to_numpy()
    left, right = pivot_pairs(np.cumsum(change), rows.column("fp").to_numpy().view(np.uint64), RADIUS)
    # The smaller set's share of the larger one bounds the similarity.
    near = np.minimum(n[left], n[right]) >= SIMILARITY * np.maximum(n[left], n[right])
    return left[near], right[near]


def _edges(rows: pa.Table, root: np.ndarray) -> pa.RecordBatch:
    h, moved = rows.column("h").to_numpy(), root != np.arange(rows.num_rows)
    return pa.RecordBatch.from_arrays([pa.array(h[moved]), pa.array(h[root[moved]])], names=["u", "v"])


def candidates(classes: DataFrame) -> DataFrame:
    """(u, v): names of sets that may be similar, as a spanning forest of each place's close pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, TILE):
            yield _edges(rows, forest(rows.num_rows, *close_pairs(rows)))

    TILE = TILE_ROWS
    placed = classes.select(F.explode("bands").alias("k"), "h", "n", "fp")
    return tiled(placed, "k", F.lit(1), TILE_ROWS).mapInArrow(run, "u long, v long")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(many, few), max(0, len(many) - 1))
    shared = int((many[at] == few).sum()) if len(few) else 0
    return shared * 10 >= (len(a) + len(b) - shared) * round(10 * SIMILARITY)


def verified(rows: pa.Table) -> np.ndarray:
    """For each row the smallest row that it is connected with by pairs of sufficient similarity."""
    sets = [np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist()]
    left, right = close_pairs(rows)
    root = np.arange(len(sets))
    while len(left):
        now = slice(0, 512)
        good = np.array([similar(sets[a], sets[b]) for a, b in zip(left[now].tolist(), right[now].tolist())])
        here = np.arange(len(sets))
        root = forest(len(sets), np.concatenate([here, left[now][good]]), np.concatenate([root, right[now][good]]))
        left, right = left[512:], right[512:]
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
    return root


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): names of sets whose similarity was verified, enough of them to connect what all such pairs connect."""
    groups = connected_components(candidates(classes))
    wanted = groups.join(classes.select("h", "n", "fp", "least"), groups.node == F.col("h")).select("root", "h", "n", "fp", F.col("least.doc_id").alias("l_id"), F.col("least.th").alias("l_th"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x) for x in b.column(4).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["root", "h", "n", "fp", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 64):
            yield _edges(rows, verified(rows))

    members = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("th") == F.col("l_th"))).select("root", "h", "n", "fp", "text")
    sets = checkpointed(members.mapInArrow(read, "root long, h long, n long, fp long, hashes binary"))
    return tiled(sets, "root", F.col("n"), TILE_SHINGLES).mapInArrow(run, "u long, v long")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, first): for each row the smallest (z, doc_id, th) of its component, z being 1 for a null id."""
    bounded_batches(docs.sparkSession)
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").withColumn("th", F.xxhash64("text"))
    rows = checkpointed(sketches(texts))
    place = F.struct(F.col("doc_id").isNull().cast("int").alias("z"), "doc_id", "th")
    # One row stands for all rows with the same set.
    classes = rows.groupBy("h").agg(F.min(place).alias("least"), F.first(F.struct("n", "fp", "bands")).alias("x")).select("h", "least", "x.*")
    classes = checkpointed(classes)
    comps = connected_components(links(texts, classes))
    rooted = classes.join(comps, classes.h == comps.node, "left").select("h", "least", F.coalesce("root", "h").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return rows.select("doc_id", "th", "h").join(rooted.join(named, "root").select("h", "first"), "h").select("doc_id", "th", "first")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id), one row per input row: the smallest id that pairs of sufficient similarity connect it with.

    Null and empty texts and texts without words are copies of each other. A null id gets its component's smallest id, or null if
    all of its ids are null. Rows that repeat are rows of one component. An empty table gives an empty table; other columns are ignored.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", F.col("first.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document for each component: that with the smallest id (null last), then text hash.

    A document is an id and a text: rows that repeat both stay or go together. Of rows that share an id or have none each is judged by
    its text. Very long texts are sets of shingles as large as their number of different ones.
    """
    found = _grouped(docs, id_col, text_col)
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).select("doc_id", "th").distinct()
    return without_rows(docs, gone, id_col, text_col)
