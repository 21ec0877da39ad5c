"""Field paths over the event row, compiled to columns; absent and null are told apart."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.canonical import dumps, quoted

PATH = ("original", "comparison_key", "normalization_profile")
PROCESS = ("pid", "ppid", "command_line")
IMAGE = ("original", "comparison_key")


@dataclass
class Field:
    """``present``: the path resolves; ``kind``: string, number, boolean, null, array or object; ``text``: strings
    without quotes, numbers and booleans as text, else null; ``json``: canonical JSON."""

    present: Column
    kind: Column
    text: Column
    json: Column


def from_text(column: Column) -> Field:
    return Field(column.isNotNull(), F.lit("string"), column, quoted(column))


def from_number(column: Column) -> Field:
    return Field(column.isNotNull(), F.lit("number"), column.cast("string"), column.cast("string"))


def from_json(present: Column, value: Column) -> Field:
    head = F.substring(value, 1, 1)
    kind = F.when(head == '"', "string").when(head == "[", "array").when(head == "{", "object").when(value == "null", "null").when(value.isin("true", "false"), "boolean").otherwise("number")
    plain = F.when(~value.contains("\\"), F.substring(value, 2, F.length(value) - 2)).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))
    text = F.when(kind == "string", plain).when(kind.isin("number", "boolean"), value)
    return Field(F.coalesce(present, F.lit(False)), kind, text, value)


def attribute(key: str) -> Field:
    attributes = F.col("attributes")
    return from_json(F.map_contains_key(attributes, key), F.element_at(attributes, key))


def absent() -> Field:
    nothing = F.lit(None).cast("string")
    return Field(F.lit(False), nothing, nothing, nothing)


def resolve(path: str) -> Field:
    """A field path of a sequence rule. Unknown names below path and process are absent; other names are attributes."""
    if path in ("hostname", "user", "program", "message", "event_type", "assertion", "source"):
        return from_text(F.col(path))
    head, _, rest = path.partition(".")
    if head == "attributes" and rest:
        return attribute(rest)
    if head == "path" and rest:
        return from_text(F.col(f"path.{rest}")) if rest in PATH else absent()
    if head == "process" and rest:
        inner, _, last = rest.partition(".")
        if inner == "image_path" and last in IMAGE:
            return from_text(F.col(f"process.image_path.{last}"))
        if rest in PROCESS:
            return (from_text if rest == "command_line" else from_number)(F.col(f"process.{rest}"))
        return absent()
    return attribute(path)


def equals(field: Field, value: Any, case_sensitive: bool) -> Column:
    """Type-strict equality with a literal."""
    if isinstance(value, str):
        same = field.text == value if case_sensitive else F.lower(field.text) == value.lower()
        return F.coalesce(field.present & (field.kind == "string") & same, F.lit(False))
    text = dumps(value)
    if isinstance(value, (list, dict)) and not case_sensitive:
        return F.coalesce(field.present & (F.lower(field.json) == text.lower()), F.lit(False))
    return F.coalesce(field.present & (field.json == text), F.lit(False))


def equals_field(a: Field, b: Field, case_sensitive: bool) -> Column:
    same = a.json == b.json if case_sensitive else F.lower(a.json) == F.lower(b.json)
    return F.coalesce(a.present & b.present & (a.kind == b.kind) & same, F.lit(False))


def stringified(value: Any) -> str | None:
    if isinstance(value, str):
        return value
    return json.dumps(value) if isinstance(value, (bool, int, float)) else None
