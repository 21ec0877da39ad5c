"""Nearest neighbours by a block matrix join.

Vectors are normalised and quantised to int8, once each. Queries and candidates meet as blocks of codes; a tile is one matrix product
whose entries are cosines up to a bound that follows from the residuals' norms. Candidates whose upper bound reaches the k-th best
lower bound of their query survive, first in their tile, then over all tiles. Only then are the survivors' original vectors fetched and
recomputed in double precision; heaps merge the best of each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, pick

K = 5
EVERY = 50
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, step, norm of the residual and of the dequantised vector, norm; of double rows, all nonzero."""
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / norm[:, None]
    step = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / step[:, None]).astype(np.int8)
    back = code * step[:, None]
    return code, step, np.sqrt(((unit - back) ** 2).sum(axis=1)), np.sqrt((back * back).sum(axis=1)), norm


def tile(q_ids: np.ndarray, q: tuple[np.ndarray, ...], c_ids: np.ndarray, c: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """(query, candidate, lower, upper) of the pairs of one tile that can be among their query's ``k`` best. Rows are (codes, step, residual, norm)."""
    (qc, qs, qe, qb), (cc, cs, ce, _) = q, c
    # Products of int8 codes and their sums up to 1040 dimensions are exact in single precision.
    kind = np.float32 if qc.shape[1] <= 1040 else np.float64
    product = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    bound = qe[:, None] + qb[:, None] * ce[None, :] + 1e-9
    own = q_ids[:, None] == c_ids[None, :]
    lower = np.where(own, -np.inf, product - bound)
    m = min(k, len(c_ids))
    best = np.partition(lower, len(c_ids) - m, axis=1)[:, len(c_ids) - m]
    a, b = np.nonzero((product + bound >= best[:, None]) & ~own)
    return a, b, lower[a, b], (product + bound)[a, b]


def _packed(rows: DataFrame, kind: int, per: int, others: int) -> DataFrame:
    """Codes as (a, b, side, ...): each goes to its block's tiles with all blocks of the other side."""
    block = F.pmod(F.xxhash64(F.lit(kind), "vec_id"), F.lit(per)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    a, b = ("own", "other") if kind == 0 else ("other", "own")
    return rows.withColumn("own", block).withColumn("other", other).select(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b"), F.lit(kind).alias("side"), "vec_id", "vh", "codes", "step", "residual", "norm")


def _codes(rows: DataFrame) -> DataFrame:
    """(vec_id, vh, codes, step, residual, norm): int8 codes of (vec_id, vh, embedding), and what bounds their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                code, step, residual, norm, _ = quantise(x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in code], pa.binary()), *map(pa.array, (step, residual, norm))], names=["vec_id", "vh", "codes", "step", "residual", "norm"])

    return rows.select("vec_id", "vh", "embedding").mapInArrow(run, "vec_id long, vh long, codes binary, step double, residual double, norm double")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` candidates of the largest cosine, nearest first.

    Every row of ``vectors`` but those with the query's id is a candidate; ties go to the smaller id. Vectors that
    are null, zero, or hold null or non-finite components, rows without an id, and rows whose length differs
    from the most common one of the queries take no part. Rows that repeat id and vector count once. A query without candidates has no
    rows; empty tables give an empty table; other columns are ignored.
    """
    bounded_batches(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        big = F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return pick(df, vec_id=id_col, embedding=vector_col).select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine).where(big > 0).distinct().withColumn("vh", F.xxhash64("embedding"))

    asked, rows = checkpointed(usable(queries)), checkpointed(usable(vectors))
    common = asked.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = common["d"] if common else 0
    asked, rows = asked.where(F.size("embedding") == dims), rows.where(F.size("embedding") == dims)
    n_a, n_b = max(1, -(-asked.count() // query_block)), max(1, -(-rows.count() // candidate_block))
    # The codes cross the network once for each block of the other side; the vectors only for pairs that survive.
    dealt = _packed(_codes(asked), 0, n_a, n_b).union(_packed(_codes(rows), 1, n_b, n_a))
    dealt = dealt.repartition(n_a * n_b, "a", "b").sortWithinPartitions("a", "b", "side")

    def survivors(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        if held[0] and held[1]:
            (qi, qh, *q), (ci, ch, *c) = ([np.concatenate(x) for x in zip(*held[s], strict=True)] for s in (0, 1))
            for at in range(0, len(qi), 256):
                part = slice(at, at + 256)
                a, b, low, high = tile(qi[part], tuple(x[part] for x in q), ci, tuple(c), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qi[part][a], qh[part][a], ci[b], ch[b], low, high)], names=["query_id", "query_vh", "vec_id", "vh", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {0: [], 1: []}
        for batch in batches:
            a, b, side, ids, vh = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            codes = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.int8).reshape(batch.num_rows, -1) if batch.num_rows else None
            rest = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6, 9)]
            cuts = [0, *(np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(a)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if now != (a[x], b[x]):
                    yield from survivors(held)
                    now, held = (a[x], b[x]), {0: [], 1: []}
                held[int(side[x])].append((ids[x:y], vh[x:y], codes[x:y], *(r[x:y] for r in rest)))
        yield from survivors(held)

    near = dealt.mapInArrow(run, "query_id long, query_vh long, vec_id long, vh long, low double, high double")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each query's survivors, those whose upper bound reaches the k-th best lower bound over all tiles."""
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            low, high = (rows.column(c).to_numpy() for c in ("low", "high"))
            best = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            yield from rows.filter(pa.array(high >= best)).select(["query_id", "query_vh", "vec_id", "vh"]).to_batches()

        for b in batches:
            q, h = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(q) != 0) | (np.diff(h) != 0)) + 1).tolist(), len(q)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (q[x], h[x]):
                    yield from done()
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield from done()

    left = near.repartition("query_id", "query_vh").sortWithinPartitions("query_id", "query_vh").mapInArrow(prune, "query_id long, query_vh long, vec_id long, vh long")
    pairs = left.join(rows.select("vec_id", "vh", F.col("embedding").alias("y")), ["vec_id", "vh"]).join(asked.select(F.col("vec_id").alias("query_id"), F.col("vh").alias("query_vh"), F.col("embedding").alias("x")), ["query_id", "query_vh"])

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for i in (2, 3))
            score = (x * y).sum(axis=1) / (np.sqrt((y * y).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = pairs.select("query_id", "vec_id", "x", "y").mapInArrow(recompute, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []

        def done() -> pa.RecordBatch:
            rows = [(now, r + 1, v, s) for r, (s, v) in enumerate((-s, v) for s, v in heapq.nsmallest(k, set(heap)))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.float64()], strict=True)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, v, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if q != now:
                    if heap:
                        yield done()
                    now, heap = q, []
                heap.append((-s, v))
        if heap:
            yield done()

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
