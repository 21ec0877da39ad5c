"""Case files: one JSON document, or JSON lines with an envelope for each record."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


RECORD_TYPES = ("case", "evidence", "artifact", "event", "issue", "match", "finding", "manifest")
TOP_LEVEL = ("schema_version", "case", "evidence", "artifacts", "events", "issues", "matches", "findings", "manifest")


class CaseError(ValueError):
    pass


def check_version(version: str, expected: int = 1) -> None:
    """The major version must be the expected one; higher minor versions are accepted."""
    m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", version)
    if not m or int(m[1]) != expected:
        raise CaseError(f"schema version {version!r}")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, schema_version, record) of a JSON lines case; ``record`` is JSON text. Blank lines are skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    kind, version = F.get_json_object("value", "$.record_type"), F.get_json_object("value", "$.schema_version")
    # A blank line has a type of its own: its test may run after those that a plan puts beside it.
    return raw.select(F.when(F.trim("value") == "", "blank").otherwise(kind).alias("record_type"), version.alias("schema_version"), F.get_json_object("value", "$.record").alias("record"))


def checked(records: DataFrame) -> DataFrame:
    """The same records; an unknown record type, version or a missing record is an error when it is read."""
    good = (F.col("record_type") == "blank") | F.col("record_type").isin(*RECORD_TYPES) & F.col("schema_version").rlike(r"^1\.\d+\.\d+$") & F.col("record").isNotNull()
    return records.withColumn("record", F.when(F.coalesce(good, F.lit(False)), F.col("record")).otherwise(F.raise_error(F.concat(F.lit("bad record of type "), F.coalesce("record_type", F.lit("null"))))))


def events_of(records: DataFrame) -> DataFrame:
    """Event rows of (record_type, record) lines; attributes become a map of JSON texts."""
    schema = "event_id string, time struct<type:string,value:string,timezone:string,start:string,end:string,original:string,kind:string,precision:string,timezone_source:string,uncertainty_ms:bigint>, source string, event_type string, assertion string, hostname string, user string, path struct<original:string,comparison_key:string,normalization_profile:string>, program string, process struct<pid:bigint,ppid:bigint,command_line:string,image_path:struct<original:string,comparison_key:string,normalization_profile:string>>, message string, attributes map<string,string>, provenance struct<evidence_id:string,artifact_id:string,source_locator:string,source_sha256:string,parser_id:string,parser_version:string,record_locator:string,source_ordinal:bigint>"
    parsed = records.where("record_type = 'event'").select("record", F.from_json("record", schema, {"mode": "FAILFAST"}).alias("e")).select("record", "e.*")
    # from_json drops the quotes of strings in a map of strings: each value's JSON text is taken from the variant instead.
    texts = F.from_json(F.get_json_object("record", "$.attributes"), "map<string,variant>")
    return parsed.withColumn("attributes", F.transform_values(texts, lambda _, v: F.to_json(v))).drop("record")


def read_jsonl(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Event rows under "event", and the JSON records of each other type under its name."""
    records = checked(lines(spark, path))
    return {t: events_of(records) if t == "event" else records.where(F.col("record_type") == t).select("record") for t in RECORD_TYPES}


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same of a case that is one JSON document."""
    whole = spark.read.text(path, wholetext=True)
    version = whole.select(F.get_json_object("value", "$.schema_version")).first()
    check_version(version[0] if version and version[0] else "")
    out = {}
    for name in RECORD_TYPES:
        key = {"case": "case", "evidence": "evidence", "manifest": "manifest"}.get(name, {"match": "matches"}.get(name, f"{name}s"))
        body = F.get_json_object("value", f"$.{key}")
        items = F.when(F.substring(body, 1, 1) == "[", F.from_json(body, "array<variant>")).otherwise(F.array(F.parse_json(body)))
        records = whole.select(F.explode(items).alias("v")).where("v IS NOT NULL").select(F.lit(name).alias("record_type"), F.to_json("v").alias("record"))
        out[name] = events_of(records) if name == "event" else records.select("record")
    return out
