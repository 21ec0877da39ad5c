"""Evidence: listing, content tables, probing and its resolution, container checks, limits."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions import ids
from ..storage import checkpointed

MAX_DEPTH, MAX_FILES = 64, 100_000

# Magic bytes of containers that are not read, as (offset, hex).
CONTAINERS = {"e01": (0, "455646090D0AFF00"), "vmdk": (0, "4B444D56"), "7z": (0, "377ABCAF271C"), "rar4": (0, "526172211A0700"), "rar5": (0, "526172211A070100"), "zip": (0, "504B0304"), "gzip": (0, "1F8B"), "tar": (257, "7573746172")}
# First bytes of the formats that parsers confirm.
MAGIC = {"lnk": (0, "4C0000000114020000000000C000000000000046"), "prefetch": (4, "53434341"), "prefetch_mam": (0, "4D414D04"), "evtx": (0, "456C6646696C6500"), "registry": (0, "72656766"), "jump_list": (0, "D0CF11E0A1B11AE1")}


@dataclass
class Listing:
    files: list[tuple[str, str]] = field(default_factory=list)  # locator, path
    symlinks: list[str] = field(default_factory=list)
    truncated: bool = False


def escape_name(name: bytes) -> str:
    """Bytes that are not UTF-8 as %XX; a percent sign stays."""
    out, at = [], 0
    while at < len(name):
        for n in (1, 2, 3, 4):
            try:
                out.append(name[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(f"%{name[at]:02X}")
            at += 1
    return "".join(out)


def normalize_locator(path: str) -> str:
    """Forward slashes, NFC, no empty components; absolute, empty or dotted paths are errors."""
    forward = unicodedata.normalize("NFC", path.replace("\\", "/"))
    parts = [p for p in forward.split("/") if p]
    if forward.startswith("/") or not parts or any(p in (".", "..") for p in parts) or parts[0][1:2] == ":":
        raise ValueError(f"locator {path!r}")
    return "/".join(parts)


def discover(root: str, max_depth: int = MAX_DEPTH, max_files: int = MAX_FILES) -> Listing:
    """Regular files below ``root`` in the byte order of their locators. Links are noted and not followed."""
    if os.path.islink(root):
        raise ValueError("the root is a symbolic link")
    out = Listing()
    if os.path.isfile(root):
        out.files.append((normalize_locator(escape_name(os.fsencode(os.path.basename(root)))), root))
        return out
    todo = [(os.fsencode(root), 0)]
    while todo:
        folder, depth = todo.pop()
        for e in os.scandir(folder):
            name = normalize_locator(escape_name(os.path.relpath(e.path, os.fsencode(root))))
            if e.is_symlink():
                out.symlinks.append(name)
            elif e.is_dir() and depth < max_depth:
                todo.append((e.path, depth + 1))
            elif e.is_file():
                out.files.append((name, os.fsdecode(e.path)))
    out.files.sort(key=lambda x: x[0].encode())
    out.symlinks.sort()
    out.truncated = len(out.files) > max_files
    out.files = out.files[:max_files]
    return out


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """(source_locator, size, sha256, content) of all files below a folder that Spark reads."""
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    return files.select(F.regexp_replace(F.replace(bare, base, F.lit("")), "^/+", "").alias("source_locator"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def with_ids(contents: DataFrame, domain: str = ids.DOMAIN) -> DataFrame:
    return contents.withColumn("evidence_id", ids.evidence_id(F.col("source_locator"), F.col("size"), F.col("sha256"), domain))


HEADER = 512


def with_header(contents: DataFrame) -> DataFrame:
    """The first 512 bytes of each content as column ``header``: all that probes by magic bytes read."""
    return contents.withColumn("header", F.substring("content", 1, HEADER))


def starts_at(content: Column, offset: int, magic: str) -> Column:
    return F.hex(F.substring(content, offset + 1, len(magic) // 2)) == magic


def container_kind(content: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, (offset, magic) in reversed(CONTAINERS.items()):
        out = F.when(starts_at(content, offset, magic), kind).otherwise(out)
    return out


def format_kind(content: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, (offset, magic) in reversed(MAGIC.items()):
        out = F.when(starts_at(content, offset, magic), kind).otherwise(out)
    return out


def inspect(contents: DataFrame) -> DataFrame:
    return contents.select("source_locator", "size", "sha256", F.lower(F.hex(F.substring("content", 1, 8))).alias("first_bytes"), F.coalesce(format_kind(F.col("content")), container_kind(F.col("content"))).alias("kind"))


def resolve_probes(probes: DataFrame) -> DataFrame:
    """(evidence_id, decision, parsers, issue) from (evidence_id, parser_id, outcome).

    Malformed anywhere skips the evidence; one confirmed parser runs; of several only the pair amcache and registry
    runs; probable ones alone are parsed too, with an issue that says so.
    """
    of = lambda o: F.array_sort(F.collect_set(F.when(F.col("outcome") == o, F.col("parser_id"))))
    g = probes.groupBy("evidence_id").agg(F.max(F.col("outcome") == "malformed").alias("bad"), of("confirmed").alias("sure"), of("probable").alias("maybe"))
    pair = F.col("sure") == F.array(F.lit("amcache"), F.lit("registry"))
    sure, maybe = F.size("sure"), F.size("maybe")
    decision = F.when(F.col("bad"), "skip").when((sure == 1) | pair, "run").when(sure > 1, "skip").when(maybe > 0, "run_probable").otherwise("none")
    issue = F.when(F.col("bad"), "TF-W-PROBE-MALFORMED").when((sure > 1) & ~pair, "TF-W-PROBE-AMBIGUOUS").when((sure == 0) & (maybe > 0), "TF-W-PROBE-PROBABLE-ONLY")
    chosen = F.when(decision == "run", F.col("sure")).when(decision == "run_probable", F.col("maybe")).otherwise(F.array().cast("array<string>"))
    return g.select("evidence_id", decision.alias("decision"), chosen.alias("parsers"), issue.alias("issue"))


def distinct_by_hash(contents: DataFrame) -> DataFrame:
    """One row for each sha256, with the first locator; hot hashes are combined where they are."""
    return contents.groupBy("sha256").agg(F.min("source_locator").alias("source_locator"), F.count("*").alias("copies"))


def _admit(sizes: list[int], total: int, limit: int) -> tuple[list[int], list[bool], int]:
    """Sums with each size in turn, whether it was taken, and the sum of those taken."""
    sums, within = [], []
    for size in sizes:
        fits = total + size <= limit
        sums.append(total + size)
        within.append(fits)
        total += size if fits else 0
    return sums, within, total


def running_bytes(evidence: DataFrame, limit: int) -> DataFrame:
    """Evidence with ``running``, the bytes taken up to it and with it in locator order, and ``within``, whether it is taken.

    Evidence that does not fit is passed over and not counted: smaller ones behind it may still fit. Ranges of the order that
    fit as a whole, or of which nothing fits, need their sums and smallest sizes only; any other is gone through once to learn
    where the next begins. Pass sizes without contents.
    """
    rows = checkpointed(evidence.orderBy("source_locator", "evidence_id"))
    part = F.spark_partition_id()
    known = sorted((r["p"], r["s"], r["least"]) for r in rows.groupBy(part.alias("p")).agg(F.sum("size").alias("s"), F.min("size").alias("least")).collect())
    starts, total = {}, 0
    for p, s, least in known:
        starts[p] = total
        if total + s <= limit:
            total += s
        elif total + least <= limit:

            def end(batches: Iterator[pa.RecordBatch], total: int = total) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    total = _admit(b.column(0).to_pylist(), total, limit)[2]
                    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["t"])

            found = rows.where(part == p).select(F.col("size").cast("long")).mapInArrow(end, "t long").agg(F.max("t").alias("t")).first()
            total = found["t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = starts.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            sums, within, total = _admit(b.column(b.schema.get_field_index("size")).to_pylist(), total, limit)
            yield b.append_column("running", pa.array(sums, pa.int64())).append_column("within", pa.array(within, pa.bool_()))

    schema = StructType([*rows.schema.fields, StructField("running", LongType()), StructField("within", BooleanType())])
    return rows.mapInArrow(run, schema)


def verify_snapshot(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_locator, status, issue): evidence as it was hashed (source_locator, size, sha256) held against the copy that was read back.

    Equal size and hash make a verified snapshot. A copy that is missing, a size or a hash that differs is a failed one, with its
    issue. Copies of nothing are ignored. Everything downstream reads verified snapshots alone.
    """
    a = before.select("source_locator", F.col("size").alias("__size"), F.col("sha256").alias("__sha"))
    b = after.select("source_locator", "size", "sha256", F.lit(True).alias("__there"))
    issue = F.when(F.col("__there").isNull(), "TF-W-SNAPSHOT-MISSING").when(~F.col("__size").eqNullSafe(F.col("size")), "TF-W-SNAPSHOT-SIZE").when(~F.col("__sha").eqNullSafe(F.col("sha256")), "TF-W-SNAPSHOT-HASH")
    return a.join(b, "source_locator", "left").select("source_locator", F.when(issue.isNull(), "verified_snapshot").otherwise("snapshot_failed").alias("status"), issue.alias("issue"))

def select_mode(evidence: DataFrame, mode: str, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Verified evidence for a scan, and the wanted ids that name none. Modes: all, suspicious, explicit."""
    verified = evidence.where(F.col("status") == "verified_snapshot")
    if mode == "all":
        return verified, None
    return verified.join(wanted, "evidence_id", "left_semi"), wanted.join(verified, "evidence_id", "left_anti")
