"""One analysis: snapshots, parsing, rules, findings, limits, and the case that holds them."""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .operators import findings, scan, timeline
from .plans import correlation, sigma
from .sources import evidence
from .sources.parsers import parse_contents
from .storage import shared_folder

MATCH = ("match_id", "match_type", "rule_id", "rule_sha256", "event_ids", "evidence_ids", "reasons")
ISSUE = "issue_code string, issue_message string, evidence_id string, artifact_id string"


class AnalysisError(ValueError):
    pass


@dataclass
class Analysis:
    evidence: DataFrame
    events: DataFrame
    issues: DataFrame
    matches: DataFrame | None
    findings: DataFrame | None
    limited: bool
    notes: list[str] = field(default_factory=list)


def issue_rows(rows: DataFrame, code: str, message: Column | str, evidence_id: Column | None = None) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(code).alias("issue_code"), text.alias("issue_message"), (F.lit(None) if evidence_id is None else evidence_id).cast("string").alias("evidence_id"), F.lit(None).cast("string").alias("artifact_id"))


def at_most(rows: DataFrame, limit: int, order: list[Column | str], code: str) -> tuple[DataFrame, DataFrame | None]:
    """The first ``limit`` rows, and an issue if there are more. Up to the limit nothing is sorted."""
    if rows.limit(limit + 1).count() <= limit:
        return rows, None
    return rows.orderBy(*order).limit(limit), issue_rows(rows.sparkSession.range(1), code, f"more than {limit}")


def checked_ids(events: DataFrame) -> DataFrame:
    """``events``, whose ids must be distinct."""
    twice = events.groupBy("event_id").count().where("count > 1").select("event_id").limit(3).collect()
    if twice:
        raise AnalysisError(f"event ids repeat: {', '.join(r['event_id'] for r in twice)}")
    return events


def byte_matches(contents: DataFrame, rules: list, max_bytes: int | None) -> DataFrame:
    """Byte-pattern hits as matches. Their ids name the rule alone, so a match is told by its id and its evidence."""
    hits = scan.scan(contents, rules, max_bytes)
    nothing = F.array().cast("array<string>")
    shown = F.array(F.concat(F.lit("patterns found: "), F.coalesce(F.nullif(F.array_join("matched", ", "), F.lit("")), F.lit("none"))))
    return hits.select(ids.match_id(F.col("rule_id"), F.col("rule_sha256"), nothing).alias("match_id"), F.lit("yara_x").alias("match_type"), "rule_id", "rule_sha256", nothing.alias("event_ids"), F.array("evidence_id").alias("evidence_ids"), shown.alias("reasons"))


def rule_matches(events: DataFrame, kind: str, rules: list, limits: dict) -> tuple[list[DataFrame], list[str]]:
    """Matches of single-event or sequence rules, and the ids of sequence rules whose window is beyond the limit."""
    if kind == "sigma":
        return [sigma.match(events, rules)] if rules else [], []
    short = [r for r in rules if r.within <= limits["max_correlation_window_seconds"] * 1000]
    for r in short:
        r.max_matches = min(r.max_matches or limits["max_correlation_matches_per_rule"], limits["max_correlation_matches_per_rule"])
    return [correlation.match(timeline.with_instants(events, r.allow_uncertain), r) for r in short], [r.rule_id for r in rules if r not in short]


def unite(frames: list[DataFrame]) -> DataFrame | None:
    """Matches of all engines, each (id, evidence) once."""
    known = [f.select(*MATCH, *[c for c in ("score", "score_base", "truncated") if c in f.columns]) for f in frames]
    if not known:
        return None
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), known).dropDuplicates(["match_id", "evidence_ids"])


def analyze(spark: SparkSession, root: str, settings: dict, compiled: dict[str, list], work: str | None = None, merge: list[findings.MergeRule] | None = None) -> Analysis:
    """Everything about the files below ``root``. ``work`` (or the shared folder) takes the snapshot and the parsed rows.

    Files are hashed, copied, read back and hashed again; only verified copies are parsed and scanned. Compiled rules are those of
    the kinds sigma, correlation and yara. The limits of ``settings`` hold; each that is reached leaves an issue.
    """
    limits = settings["limits"]
    work = work or f"{shared_folder(spark)}/analysis-{uuid.uuid4().hex}"
    issues: list[DataFrame] = []

    def limited(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
        kept, issue = at_most(rows, limits[name], list(order), f"TF-W-LIMIT-{name.replace('_', '-').upper()}")
        issues.extend([issue] if issue is not None else [])
        return kept

    files = evidence.with_ids(evidence.read_contents(spark, root))
    listed = limited(files.select("evidence_id", "source_locator", "size", "sha256"), "max_files", "source_locator")
    large = listed.where(F.col("size") > limits["max_evidence_file_size_bytes"])
    issues.append(issue_rows(large, "TF-W-LIMIT-MAX-EVIDENCE-FILE-SIZE-BYTES", F.col("size").cast("string"), F.col("evidence_id")))
    counted = evidence.running_bytes(listed.where(F.col("size") <= limits["max_evidence_file_size_bytes"]), limits["max_snapshot_total_bytes"])
    issues.append(issue_rows(counted.where("NOT within"), "TF-W-LIMIT-MAX-SNAPSHOT-TOTAL-BYTES", F.col("running").cast("string"), F.col("evidence_id")))
    before = counted.where("within").select("evidence_id", "source_locator", "size", "sha256")

    files.join(before.select("evidence_id"), "evidence_id", "left_semi").select("evidence_id", "source_locator", "content").write.parquet(f"{work}/snapshot")
    copies = spark.read.parquet(f"{work}/snapshot")
    status = evidence.verify_snapshot(before, copies.select("source_locator", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256")))
    known = before.join(status, "source_locator").select("evidence_id", "source_locator", "size", "sha256", "status", "issue")
    known.write.parquet(f"{work}/evidence")
    known = spark.read.parquet(f"{work}/evidence")
    issues.append(known.where("issue IS NOT NULL").select(F.col("issue").alias("issue_code"), F.col("source_locator").alias("issue_message"), "evidence_id", F.lit(None).cast("string").alias("artifact_id")))
    verified = copies.join(known.where("status = 'verified_snapshot'").select("evidence_id"), "evidence_id", "left_semi")

    parse_contents(verified.select("source_locator", "content")).write.parquet(f"{work}/parsed")
    rows = spark.read.parquet(f"{work}/parsed")
    events = checked_ids(rows.where("event_id IS NOT NULL").drop("issue_code", "issue_message"))
    keyed = timeline.with_key(events)
    events = limited(keyed, "max_events", "time_group", *[F.asc_nulls_last(c) for c in timeline.ORDER[1:-1]], "event_id").select(*events.columns)
    issues.append(rows.where("issue_code IS NOT NULL").select("issue_code", "issue_message", F.col("provenance.evidence_id").alias("evidence_id"), F.col("provenance.artifact_id").alias("artifact_id")))

    frames, notes = [], []
    for kind in ("sigma", "correlation"):
        found, beyond = rule_matches(events, kind, compiled.get(kind, []), limits)
        frames += found
        for name in beyond:
            issues.append(issue_rows(spark.range(1), "TF-W-LIMIT-MAX-CORRELATION-WINDOW-SECONDS", name))
    if rules := compiled.get("yara"):
        mode = settings["yara"]["mode"]
        named = unite(frames)
        wanted = named.select(F.explode("evidence_ids").alias("evidence_id")).distinct() if named is not None and mode == "suspicious" else spark.createDataFrame([], "evidence_id string")
        chosen, lost = evidence.select_mode(known, mode, wanted)
        if lost is not None:
            issues.append(issue_rows(lost, "TF-W-YARA-EVIDENCE-UNRESOLVED", F.col("evidence_id"), F.col("evidence_id")))
        body = copies.join(chosen.select("evidence_id"), "evidence_id", "left_semi").select("evidence_id", "content")
        most = limits["max_yara_scan_file_size_bytes"]
        frames.append(byte_matches(body, rules, most))
        issues.append(issue_rows(scan.oversized(body, most), "TF-W-LIMIT-MAX-YARA-SCAN-FILE-SIZE-BYTES", F.col("size").cast("string"), F.col("evidence_id")))
    matches = unite(frames)
    made = None
    if matches is not None:
        matches.write.parquet(f"{work}/matched")
        matches = spark.read.parquet(f"{work}/matched")
        made = findings.build(matches, merge or [])
        if findings.lost(matches, made).limit(1).count():
            raise AnalysisError("a match has no finding")
        made = limited(made, "max_findings", findings.severity_rank(F.col("severity")).desc(), "finding_id")
    united = functools.reduce(DataFrame.unionByName, issues)
    reached = united.where(F.col("issue_code").startswith("TF-W-LIMIT-")).limit(1).count() > 0
    united, more = at_most(united, limits["max_issues"], ["evidence_id", "issue_code", "issue_message"], "TF-W-LIMIT-MAX-ISSUES")
    return Analysis(known.drop("issue"), events, united if more is None else united.unionByName(more), matches, made, reached or more is not None, notes)
