"""Canonical JSON: keys by their UTF-8 bytes, no blanks, shortest numbers, no NaN."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def dumps(value: Any) -> str:
    def ordered(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: ordered(x[k]) for k in sorted(x, key=lambda k: k.encode())}
        return [ordered(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(ordered(value), separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def quoted(text: Column) -> Column:
    """The JSON text of a string column."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def attributes_text(attributes: Column) -> Column:
    """A map of canonical JSON texts as one canonical object."""
    entries = F.transform(F.array_sort(F.map_keys(attributes)), lambda k: F.concat(quoted(k), F.lit(":"), F.element_at(attributes, k)))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
