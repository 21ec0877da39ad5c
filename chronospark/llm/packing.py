"""Packing of token sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's whole windows leave at once; its rest goes to the
open window that it fits best. When none fits, the fullest window is filled up with the head of the rest (documents
may be cut freely) and emitted. What stays open at a partition's end is merged within the partition, and what is
then left, less than one window for each partition, is merged over all partitions. The last sequence is cut into
powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, pick

LENGTH = 2048
OPEN_WINDOWS = 32
END_ID = 1
#: Entries of each of a worker's two caches beyond which it starts anew with the next batch.
CACHE = 300_000
#: Bytes of texts that are encoded at once.
PORTION = 2 << 20
_SIMPLE = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a cache by word.

    The vocabulary drops white space and no token spans a blank or a line feed, so the parts between them are
    encoded one by one, each different part of a batch once. Parts that are Latin letters with marks behind them are one
    pre-token of letters, lower-cased, and one of marks: new letters go many at a time through the vocabulary's own model,
    without its normaliser. Every other part goes through the whole tokenizer, and so does a text that holds a special
    token's string.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters, self.others = Tokenizer.from_file(path), {}, {"": b""}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.tokenizer.model)
        # Only lower-case letters come here: they are not normalised again.
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, heads: list[str]) -> list[bytes]:
        found = list(map(self.letters.get, heads))
        new = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(new), 1000):
            some = [heads[i] for i in new[at : at + 1000]]
            got = self.model.encode(" ".join(some), add_special_tokens=False)
            data, word = np.array(got.ids, dtype="<u4").tobytes(), np.array(got.word_ids)
            cuts = [0, *(4 * (np.flatnonzero(np.diff(word)) + 1)).tolist(), len(data)]
            for i, head, x, y in zip(new[at : at + 1000], some, cuts[:-1], cuts[1:], strict=True):
                found[i] = self.letters[head] = data[x:y]
        return found

    def _others(self, parts: list[str]) -> list[bytes]:
        for part in parts:
            if part not in self.others:
                self.others[part] = self.whole(part)
        return [self.others[part] for part in parts]

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, "|".join(map(re.escape, self.special)) or "$^")
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " "), " ")
        parts = lists.flatten().dictionary_encode()
        for cache in (self.letters, self.others):
            if len(cache) > CACHE:
                cache.clear()
        self.others[""] = b""
        # Each part is a head and a tail: letters and marks, or the part as it is and nothing.
        split = pc.extract_regex(parts.dictionary, _SIMPLE)
        plain = pc.is_valid(split)
        heads = pc.utf8_lower(pc.struct_field(split, 0)).dictionary_encode()
        tails = pc.if_else(plain, pc.struct_field(split, 1), parts.dictionary).dictionary_encode()
        strings = lambda x: x.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*self._letters(strings(heads)), *self._others(strings(tails)), b""]
        first = pc.fill_null(heads.indices, len(ids) - 1).to_numpy(zero_copy_only=False)
        second = tails.indices.to_numpy(zero_copy_only=False) + len(heads.dictionary)

        known = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        which = parts.indices.to_numpy(zero_copy_only=False)
        codes = np.stack([first[which], second[which]], axis=1).ravel()
        counts = sizes[codes]
        ends = np.cumsum(counts)
        start = (np.cumsum(sizes) - sizes)[codes] - (ends - counts)
        flat = known[np.repeat(start, counts) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        offsets = lists.offsets.to_numpy()
        bounds = (4 * np.concatenate([[0], ends])[2 * (offsets - offsets[0])]).tolist()
        out = [flat[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = self.whole(texts[int(i)].as_py())
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class OpenWindows:
    """Open windows by free space, the fullest first. A window is a list of pieces (document, start, size, ids)."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.free, self.windows = length, most, [], []

    def _put(self, free: int, window: list) -> None:
        at = bisect.bisect_left(self.free, free)
        self.free.insert(at, free)
        self.windows.insert(at, window)

    def add(self, doc: tuple, start: int, size: int, data: bytes) -> Iterator[list]:
        """Place a piece of at most one window; the windows that this fills."""
        if size == self.length:
            yield [(doc, start, size, data)]
            return
        at = bisect.bisect_left(self.free, size)
        if at == len(self.free) and len(self.free) == self.most:  # none fits: fill up and emit the fullest
            free, window = self.free.pop(0), self.windows.pop(0)
            yield [*window, (doc, start, free, data[: 4 * free])]
            start, size, data = start + free, size - free, data[4 * free :]
            at = bisect.bisect_left(self.free, size)
        piece = (doc, start, size, data)
        if at == len(self.free):
            self._put(self.length - size, [piece])
            return
        free, window = self.free.pop(at), self.windows.pop(at)  # the least free space that suffices
        if free == size:
            yield [*window, piece]
        else:
            self._put(free - size, [*window, piece])

    def merge(self) -> Iterator[list]:
        """Pour the open windows together, the fullest first; all but the last come out full."""
        rest, self.free, self.windows, self.most = self.windows, [], [], 1
        for window in rest:
            for piece in window:
                yield from self.add(*piece)


def _rows(out: list) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * 8
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [*[pa.int64()] * 7, pa.binary()], strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def _tokens(path: str, length: int, windows: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        enc, space, made, out = encoder(path), OpenWindows(length, windows), 0, []

        def emit(window: list, sequence: int | None) -> None:
            offset = 0
            for (doc_id, n), start, size, data in window:
                out.append((doc_id, start, size, zlib.crc32(data), n, sequence, offset, data if keep_ids or sequence is None else None))
                offset += size

        portions = (b.slice(at, step) for b in batches for step in [max(1, b.num_rows * PORTION // max(b.nbytes, PORTION))] for at in range(0, b.num_rows, step))
        for b in portions:
            for doc_id, data in zip(b.column(0).to_pylist(), enc.batch(b.column(1)), strict=True):
                data += end
                n = len(data) // 4
                for start in range(0, n, length):
                    for window in space.add((doc_id, n), start, min(length, n - start), data[4 * start : 4 * (start + length)]):
                        emit(window, task | made)
                        made += 1
                if len(out) >= 4096:
                    yield _rows(out)
        for window in space.merge():
            emit(window, task | made)
            made += 1
        for window in space.windows:
            emit(window, None)
        yield _rows(out)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with ``keep_ids``).

    Null and empty texts are documents of one token, the closing id. Rows that repeat, and rows with a null id, are
    documents of their own. An empty table gives an empty table; other columns are ignored. No sequence holds more
    than ``length`` tokens; each is full but for those from the last merge, whose sizes are powers of two.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    # A reliable checkpoint: the open ends and the full windows must come from the same pass over the rows.
    pieces = checkpointed(rows.mapInArrow(_tokens(tokenizer_path, length, open_windows, end_id, keep_ids), PIECES).withColumn("task", F.spark_partition_id()))
    full, rest = pieces.where("sequence_id IS NOT NULL"), pieces.where("sequence_id IS NULL")

    # The rests are laid end to end: one row for each partition gives where its rest begins.
    sums = rest.groupBy("task").agg(F.sum("length").alias("size"))
    begun = sums.select("task", F.coalesce(F.sum("size").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begun"), F.sum("size").over(Window.partitionBy()).alias("total"))
    top = 1 << 62  # beyond every task's numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                whole, at, left, done = r["total"] // length * length, r["begun"] + r["offset"], r["length"], 0
                while left:
                    if at < whole:
                        first, size, number = at // length * length, length, at // length
                    else:  # the last part: one sequence for each bit of its size, the largest first
                        first, tail, bit = whole, r["total"] - whole, length
                        number = whole // length
                        while True:
                            bit >>= 1
                            if tail & bit:
                                if at < first + bit:
                                    break
                                first, number = first + bit, number + 1
                        size = bit
                    n = min(left, first + size - at)
                    data = r["ids"][4 * done : 4 * (done + n)]
                    out.append((r["doc_id"], r["start"] + done, n, zlib.crc32(data), r["doc_tokens"], top + number, at - first, data if keep_ids else None))
                    at, left, done = at + n, left - n, done + n
            yield _rows(out)

    # Offsets of rests run through a partition's one open window, so they place its pieces in the line.
    placed = rest.join(begun, "task").select("doc_id", "start", "length", "doc_tokens", "offset", "ids", "begun", "total")
    out = full.select(*[x.split()[0] for x in PIECES.split(", ")]).unionByName(placed.mapInArrow(cut, PIECES))
    return out if keep_ids else out.drop("ids")
