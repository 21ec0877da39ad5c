"""Removal of long repeated byte strings with suffix arrays built by two-stage sorting.

Suffix arrays are built only where a repeat is possible. Each window of ``length`` bytes picks the smallest hash among
its 64-byte strings as its anchor: equal windows pick equal anchors at equal places. Consecutive windows with one anchor form a
segment. Segments meet by anchor. Segments of one content are repeats as a whole; where contents differ, their suffixes are
sorted: those smaller than their successor directly, the rest induced by bucket scans, and adjacent
common prefixes of ``length`` bytes show the repeated windows.

Passages of a few dozen words can be shorter than ``length``. They lose nothing, but are counted: every 51 consecutive words
pick one of their strings of 40 words as a mark, by the smallest hash, and marks that other rows also have are shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, pick

LENGTH = 400
GRAM = 64
#: Bytes of segments that one suffix array holds, groups being kept together.
ARRAY_BYTES = 1 << 19
#: Groups with more different segments than this are resolved by hashes of their windows instead, spread over tasks.
GROUP = 2048
#: Any passage of PASSAGE words holds a mark, a string of MARK words.
PASSAGE, MARK = 51, 40
#: Bytes of texts whose marks are made at once.
MARK_BYTES = 1 << 20
#: Longer texts are read in parts that overlap by a window.
PART = 1 << 22
_POS = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(4096, _BASE))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, by doubling."""
    h = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)[data]
    size = 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (h[size:] ^ (h[size:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        size *= 2
    return h


def segments(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each run of windows with one anchor, and the anchor's hash."""
    hashes = gram_hashes(data)
    w = length - GRAM + 1
    n = len(hashes) - w + 1
    keys = (hashes & ~_POS) | np.arange(len(hashes), dtype=np.uint64)
    pad = -len(keys) % w
    rows = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    at = (np.minimum(ahead[:n], behind[w - 1 : w - 1 + n]) & _POS).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return first, np.concatenate([first[1:] - 1, [n - 1]]), hashes[at[first]]


def string_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of text[start:end] by differences of one running polynomial."""
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(text), _BASE)]))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(text), np.uint64(pow(int(_BASE), -1, 2**64)))]))
    running = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[text] * powers[:-1], dtype=np.uint64)])
    return (running[ends] - running[starts]) * inverse[starts]


def two_stage_suffix_array(text: np.ndarray, depth: int = LENGTH, ends: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` bytes, or of those before ``ends``.

    Suffixes smaller than their successor are sorted directly, equal ones as one. A scan of the buckets in ascending order
    induces each other suffix from its successor: it comes before the sorted ones of its bucket, in the order of the scan.
    """
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    following = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    smaller = np.zeros(n, dtype=bool)
    inner = following < n - 1
    smaller[inner] = text[following[inner]] < text[following[inner] + 1]
    direct = np.flatnonzero(smaller)
    until = np.minimum(direct + depth, n) if ends is None else ends[direct]
    # Strings of one hash are sorted once. That they are equal is not relied on: prefixes are compared byte by byte later.
    _, first, kind = np.unique(string_hashes(text, direct, until), return_index=True, return_inverse=True)
    data = text.tobytes()
    strings = [data[a:b] for a, b in zip(direct[first].tolist(), until[first].tolist(), strict=True)]
    rank = np.empty(len(first), dtype=np.int64)
    rank[sorted(range(len(first)), key=strings.__getitem__)] = np.arange(len(first))
    direct = direct[np.argsort(rank[kind], kind="stable")]

    total, sorted_of = np.bincount(text, minlength=256), np.bincount(text[direct], minlength=256)
    start = np.concatenate([[0], np.cumsum(total)])
    head, done = start[:-1].copy(), np.concatenate([[0], np.cumsum(sorted_of)])
    out = np.empty(n, dtype=np.int64)
    for c in np.flatnonzero(sorted_of):
        out[start[c + 1] - sorted_of[c] : start[c + 1]] = direct[done[c] : done[c + 1]]
    if n:  # the last suffix is induced by the empty one
        out[head[text[-1]]] = n - 1
        head[text[-1]] += 1
    for c in np.flatnonzero(total):
        level = out[start[c] : head[c]]
        while len(level):  # of the bucket itself, one run length after the other
            before = level[level > 0] - 1
            level = before[text[before] == c]
            out[head[c] : head[c] + len(level)] = level
            head[c] += len(level)
        scan = out[start[c] : start[c + 1]]
        before = scan[scan > 0] - 1
        before = before[text[before] > c]
        chars = text[before]
        before = before[np.argsort(chars, kind="stable")]
        at = 0
        for d, k in zip(*np.unique(chars, return_counts=True), strict=True):
            out[head[d] : head[d] + k] = before[at : at + k]
            head[d] += k
            at += k
    return out


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Lengths of the common prefixes of suffix pairs, up to ``most``."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    blocks = np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        blocks |= padded[i : i + len(text)].astype(np.uint64) << np.uint64(8 * i)
    room = np.minimum(most, len(text) - np.maximum(left, right))
    out, active, at = np.zeros(len(left), dtype=np.int64), np.arange(len(left)), 0
    while len(active):
        active = active[room[active] > at]
        differ = blocks[left[active] + at] ^ blocks[right[active] + at]
        low = differ & (~differ + np.uint64(1))
        out[active] = at + np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        active, at = active[differ == 0], at + 8
    return np.minimum(out, room)


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part the starts of windows that also start elsewhere in any part. No byte 255 may occur."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", dtype=np.uint8)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    stop = begin[owner] + sizes[owner]
    # Strings are compared up to the end of their part: what follows there is no part of a window.
    order = two_stage_suffix_array(text, length, np.minimum(np.arange(len(text)) + length, stop + 1))
    whole = stop - np.arange(len(text)) >= length
    order = order[whole[order]]
    # Windows of different hashes differ; the others are compared.
    hashed = string_hashes(text, order, order + length)
    alike = np.flatnonzero(hashed[1:] == hashed[:-1])
    same = np.zeros(max(0, len(order) - 1), dtype=bool)
    same[alike] = common_prefixes(text, order[alike], order[alike + 1], length) >= length
    hit = np.zeros(len(order), dtype=bool)
    hit[:-1] |= same
    hit[1:] |= same
    found = np.sort(order[hit])
    return np.split(found - begin[owner[found]], np.searchsorted(owner[found], np.arange(1, len(parts))))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes; touching intervals become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return starts[np.concatenate([[0], cut])], ends[np.concatenate([cut - 1, [len(ends) - 1]])]


def _intervals(starts: np.ndarray, length: int) -> list[dict]:
    a, b = merged(starts, starts + length)
    return [{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)]


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _cut(length: int):
    """Documents to segments: (doc_id, th, h, s, lo, hi, n); h is null where the repeat lies within the document."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, th, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if data is None or len(data) < length:
                    continue
                view, seen, twice = memoryview(data), {}, []
                for part in range(0, len(data) - length + 1, PART):
                    first, last, anchor = segments(np.frombuffer(view[part : part + PART + length - 1], dtype=np.uint8), length)
                    for lo, hi, h in zip((first + part).tolist(), (last + part).tolist(), anchor.view(np.int64).tolist(), strict=True):
                        key = (h, xxhash.xxh3_64_intdigest(view[lo : hi + length], 1) - (1 << 63))
                        if key in seen:
                            twice += [seen[key], (lo, hi)]
                        else:
                            seen[key] = (lo, hi)
                spans = {place: key for key, place in seen.items()}
                repeated = {spans[p] for p in twice if p in spans}
                for (h, s), (lo, hi) in seen.items():
                    for col, v in zip(cols, (doc_id, th, h, s, lo, hi, 1 + ((h, s) in repeated)), strict=True):
                        col.append(v)
                if twice:
                    places = np.array(twice)
                    for a, z in zip(*merged(places[:, 0], places[:, 1] + length), strict=True):
                        for col, v in zip(cols, (doc_id, th, None, None, int(a), int(z) - length, 0), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 4, *[pa.int32()] * 3], strict=True)], names=["doc_id", "th", "h", "s", "lo", "hi", "n"])

    return run


def _resolve(length: int):
    """Segments (h, s, data) sorted by h to (h, s, spans); a suffix array for each half megabyte of whole groups."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[2] for r in rows], length) if rows else []
        hit = [(r[0], r[1], _intervals(x, length)) for r, x in zip(rows, found, strict=True) if len(x)]
        cols = list(zip(*hit, strict=True)) if hit else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.int64(), SPANS], strict=True)], names=["h", "s", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if size >= ARRAY_BYTES and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        yield solve(rows)

    return run


def _hash_windows(length: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, s, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                view = memoryview(data)
                n = len(data) - length + 1
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)), dtype=">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([s] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["h", "s", "at", "w1", "w2"])

    return run


def marks(values: np.ndarray, bounds: np.ndarray, passage: int = PASSAGE, mark: int = MARK) -> tuple[np.ndarray, np.ndarray]:
    """(text, mark), distinct and sorted, of the texts values[bounds[i]:bounds[i + 1]]. Words are divided by ASCII white space."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(values):
        return none
    solid = ~_BLANK[values]
    edge = np.zeros(len(values) + 1, dtype=bool)
    edge[bounds] = True
    begins = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1] | edge[1:-1]]))
    if len(begins) < passage:
        return none
    owner = np.searchsorted(bounds, begins, "right") - 1
    # A letter counts by its place in its word; blanks count nothing.
    place = np.arange(len(values)) - np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [len(values)]])))
    words = np.add.reduceat(np.where(solid, _TABLE[values] * _POWERS[place & (len(_POWERS) - 1)], np.uint64(0)), begins)
    words = (words ^ (words >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    # Hashes of 1, 2, 4, ... words make up those of ``mark`` words.
    power, size, done, h = words, 1, 0, None
    while size <= mark:
        if mark & size:
            h = power if h is None else h[: len(words) - done - size + 1] * np.uint64(0x94D049BB133111EB) + power[done : len(words) - size + 1]
            h, done = h ^ (h >> np.uint64(32)), done + size
        power = power[:-size] * _BASE + (power[size:] ^ (power[size:] >> np.uint64(29))) if len(power) > size else power[:0]
        size *= 2
    w = passage - mark + 1
    n = len(words) - passage + 1
    rows = np.concatenate([h, np.full(-len(h) % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    least = np.minimum(ahead[:n], behind[w - 1 : w - 1 + n])
    within = owner[:n] == owner[passage - 1 :]
    least, owner = least[within], owner[:n][within]
    fresh = np.ones(len(least), dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    least, owner = least[fresh], owner[fresh]
    order = np.lexsort((least, owner))
    least, owner = least[order], owner[order]
    fresh = np.ones(len(least), dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], least[fresh]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) to (doc_id, th, marks) of the rows that have any."""
    for b in batches:
        for at in range(0, b.num_rows, step := max(1, b.num_rows * MARK_BYTES // max(b.nbytes, MARK_BYTES))):
            part = b.slice(at, step)
            texts = part.column(2).cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            values = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            owner, found = marks(values, bounds - bounds[0])
            counts = np.bincount(owner, minlength=part.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "th", "marks"]).filter(pa.array(counts > 0))


def shared_marks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, th, n_shared): how many of a text's marks other rows have too, for the texts (doc_id, th, text) with any."""
    found = scratch.table(docs.where(F.octet_length("text") >= 2 * PASSAGE - 1).select("doc_id", "th", "text").mapInArrow(_marked, "doc_id long, th long, marks array<long>"))
    rows = found.select("doc_id", "th", F.explode("marks").alias("m"))
    shared = rows.groupBy("m").count().where(F.col("count") > 1).select("m")
    return rows.join(shared, "m").groupBy("doc_id", "th").agg(F.size(F.collect_set("m")).cast("long").alias("n_shared"))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """(doc_id, th, spans) of each document (doc_id, th, text) that has repeats; spans may overlap."""
    plain = docs.where(F.octet_length("text") >= length).select("doc_id", "th", "text")
    cut = scratch.table(plain.mapInArrow(_cut(length), "doc_id long, th long, h long, s long, lo int, hi int, n int"))
    found = cut.where("h IS NOT NULL")
    kinds = found.groupBy("h", "s").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "th", "lo", "hi")).alias("one"))
    groups = kinds.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    met = scratch.table(kinds.join(groups, "h").select("h", "s", "n", "kinds", "one.*"))
    whole = met.where("n > 1").select("h", "s", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))

    wanted = met.where("kinds > 1").select("h", "s", "n", "kinds", F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "lo", "hi")
    data = F.substring(F.col("text").cast("binary"), F.col("lo") + 1, F.col("hi") - F.col("lo") + length)
    bytes_of = scratch.table(plain.join(wanted, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th"))).select("h", "s", "n", "kinds", data.alias("data")))
    sorted_rows = bytes_of.where(F.col("kinds") <= GROUP).select("h", "s", "data").dropDuplicates(["h", "s"]).repartition("h").sortWithinPartitions("h", "s")
    partly = sorted_rows.mapInArrow(_resolve(length), "h long, s long, spans array<struct<a:int,b:int>>")

    windows = bytes_of.where(F.col("kinds") > GROUP).select("h", "s", "data").dropDuplicates(["h", "s"]).mapInArrow(_hash_windows(length), "h long, s long, at int, w1 long, w2 long")
    twice = windows.groupBy("w1", "w2").count().where(F.col("count") > 1)
    crowded = windows.join(twice, ["w1", "w2"]).groupBy("h", "s").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + length).alias("b"))).alias("spans"))

    some = partly.union(crowded).join(whole.select("h", "s"), ["h", "s"], "left_anti")
    answers = whole.union(some)
    spans = F.when(F.col("spans").isNull(), F.array(F.struct(F.col("lo").alias("a"), (F.col("hi") + length).alias("b")))).otherwise(F.transform("spans", lambda x: F.struct((x["a"] + F.col("lo")).alias("a"), (x["b"] + F.col("lo")).alias("b"))))
    local = cut.where("h IS NULL").select("doc_id", "th", F.array(F.struct(F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))).alias("spans"))
    covered = found.join(answers, ["h", "s"]).select("doc_id", "th", spans.alias("spans")).union(local)
    return covered.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, spans.

    Each byte of a UTF-8 text is removed that lies in a string of ``length`` bytes which also starts anywhere
    else, in the same document or another; ``spans`` are the maximal removed runs [a, b). Null is an empty text. Texts
    shorter than ``length`` lose nothing. Rows that repeat are copies of each other: both lose what they share. An empty table
    gives an empty table; null ids are ids like any other; other columns are ignored.

    ``n_shared`` counts the text's marks (see above) that stand in another row too. It is positive for every text with a passage
    of 51 words that another row has, however few bytes that is, and zero for a text without one of 40 words.
    """
    bounded_batches(docs.sparkSession)
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    scratch = Scratch(docs.sparkSession)
    spans = scratch.table(repeated_spans(texts, scratch, length).select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "spans"))
    done = scratch.n - 1
    scratch.drop(*range(1, done + 1))
    shared = shared_marks(texts, scratch).select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "n_shared")
    both = spans.join(shared, F.col("r_id").eqNullSafe(F.col("s_id")) & (F.col("r_th") == F.col("s_th")), "full").select(F.coalesce("r_id", "s_id").alias("r_id"), F.coalesce("r_th", "s_th").alias("r_th"), "spans", "n_shared")
    both = scratch.table(both)
    scratch.drop(*range(done + 1, scratch.n))
    rows = texts.join(both, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left").select("doc_id", "text", "spans", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, data, found, shared in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                places = np.array([(x["a"], x["b"]) for x in found or []], dtype=np.int64).reshape(-1, 2)
                first, last = merged(places[:, 0], places[:, 1])
                kept, at = hashlib.sha256(), 0
                for x, y in zip(first.tolist(), last.tolist(), strict=True):
                    kept.update(data[at:x])
                    at = y
                kept.update(data[at:])
                out.append((doc_id, len(data), int((last - first).sum()), len(first), kept.hexdigest(), shared, [{"a": x, "b": y} for x, y in zip(first.tolist(), last.tolist(), strict=True)]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), SPANS]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, spans array<struct<a:int,b:int>>")
