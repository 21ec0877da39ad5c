"""Deterministic identifiers: SHA-256 over length-prefixed fields, as Catalyst expressions.

A field is four big-endian length bytes and its UTF-8 bytes; null is the length 0xFFFFFFFF alone; a list is
its element count (as text) and its elements. ``domain`` heads evidence and event ids: give the one that existing data
were made with to get the same ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAIN = "CHRONOSPARK"
SCHEMA_VERSION = "1.0.0"
_NULL = "FFFFFFFF"


def prefixed(value: Column) -> Column:
    """The length-prefixed bytes of one field."""
    text = value.cast("string")
    size = F.lpad(F.hex(F.octet_length(text)), 8, "0")
    return F.when(text.isNull(), F.unhex(F.lit(_NULL))).otherwise(F.concat(F.unhex(size), text.cast("binary")))


def prefixed_list(values: Column, counted: bool = True) -> Column:
    """The bytes of a list's elements, after its element count."""
    # Binary folds through hex text: aggregate() needs one type for its state.
    body = F.unhex(F.aggregate(values, F.lit(""), lambda acc, x: F.concat(acc, F.hex(prefixed(x)))))
    return F.concat(prefixed(F.size(values)), body) if counted else body


def _id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"tf-{kind}-v1:"), F.sha2(F.concat(*parts), 256))


def evidence_id(locator: Column, size: Column, sha256: Column, domain: str = DOMAIN) -> Column:
    return _id("evidence", *map(prefixed, (F.lit(f"{domain}-EVIDENCE-ID-V1"), locator, size, sha256)))


def case_id(evidence_ids: Column) -> Column:
    """Over all evidence ids in byte order, without a count."""
    return _id("case", prefixed_list(F.array_sort(evidence_ids), counted=False))


def artifact_id(evidence: Column, artifact_type: Column, parser_id: Column, parser_version: Column) -> Column:
    return _id("artifact", *map(prefixed, (evidence, artifact_type, parser_id, parser_version)))


def event_id(evidence: Column, artifact: Column, parser_id: Column, parser_version: Column, locator_json: Column, source_ordinal: Column, event_type: Column, assertion: Column, time_json: Column, event_ordinal: Column, domain: str = DOMAIN) -> Column:
    return _id("event", *map(prefixed, (F.lit(f"{domain}-EVENT-ID-V1"), F.lit(SCHEMA_VERSION), evidence, artifact, parser_id, parser_version, locator_json, source_ordinal, event_type, assertion, time_json, event_ordinal)))


def match_id(rule_id: Column, rule_sha256: Column, event_ids: Column) -> Column:
    return _id("match", prefixed(rule_id), prefixed(rule_sha256), prefixed_list(event_ids))


def rule_content(match_type: Column, rule_id: Column, rule_sha256: Column) -> Column:
    """The hash that stands for a match's rule in a finding's id: its file's, and for byte patterns, of which a file holds
    several rules, one over the file's hash and the rule's id."""
    return F.when(match_type == "yara_x", F.sha2(F.concat(prefixed(rule_sha256), prefixed(rule_id)), 256)).otherwise(rule_sha256)


def finding_id(finding_type: Column, rule_shas: Column, event_ids: Column, evidence_ids: Column) -> Column:
    return _id("finding", prefixed(finding_type), prefixed_list(F.array_sort(rule_shas)), prefixed_list(F.array_sort(event_ids)), prefixed_list(F.array_sort(evidence_ids)))


VALID_ID = r"^tf-[a-z]+-v[0-9]+:[0-9a-f]{64}$"
VALID_SHA256 = r"^[0-9a-f]{64}$"


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(VALID_ID), F.lit(False))


def valid_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike(VALID_SHA256), F.lit(False))


def short_id(value: Column) -> Column:
    """The first eight characters behind the colon."""
    return F.substring(F.substring_index(value, ":", -1), 1, 8)


def hashed(kind: str, fields: Iterable[str | int | None]) -> str:
    """The same on the driver, for parsers and tests."""
    out = b""
    for x in fields:
        if x is None:
            out += b"\xff\xff\xff\xff"
        else:
            data = str(x).encode()
            out += len(data).to_bytes(4, "big") + data
    return f"tf-{kind}-v1:{hashlib.sha256(out).hexdigest()}"
