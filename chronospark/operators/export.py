"""Sinks: CSV, flat timeline rows, JSON lines of a case, text and HTML reports, manifest counts."""

from __future__ import annotations

import html as pyhtml
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell, needs_formula_guard
from .timeline import ORDER, with_key

CSV_COLUMNS = ("event_id", "time", "time_kind", "source", "event_type", "assertion", "hostname", "user", "path", "program", "message")
SECTIONS = ("case", "evidence", "artifact", "event", "issue", "match", "finding", "manifest")


def display_time(time: Column) -> Column:
    """An instant, a local time with its zone, start/end with a slash, or unknown."""
    span = F.concat(F.coalesce(time["start"], F.lit("")), F.lit("/"), F.coalesce(time["end"], F.lit("")))
    local = F.when(time["timezone"].isNull(), time["value"]).otherwise(F.concat(time["value"], F.lit("["), time["timezone"], F.lit("]")))
    return F.when(time["type"] == "utc_instant", time["value"]).when(time["type"] == "local_time", local).when(time["type"] == "range", span).otherwise("unknown")


def public(table: DataFrame) -> DataFrame:
    """Without the columns that are the engine's own: sort keys, and names that begin with two low lines."""
    return table.drop(*[c for c in table.columns if c.startswith("__") or c in ORDER[:-1]])


def _cells() -> list[Column]:
    t = F.col("time")
    return [F.col("event_id"), display_time(t), t["kind"], F.col("source"), F.col("event_type"), F.col("assertion"), F.col("hostname"), F.col("user"), F.col("path.original"), F.col("program"), F.col("message")]


def csv_lines(events: DataFrame) -> DataFrame:
    """(line, guarded, and the timeline's key) for each event; write ``line`` in the key's order."""
    line = F.concat_ws(",", *[csv_cell(c) for c in _cells()])
    guarded = sum((needs_formula_guard(c).cast("int") for c in _cells()), F.lit(0))
    return with_key(events).select(*ORDER, line.alias("line"), guarded.alias("guarded"))


def write_csv(events: DataFrame, path: str) -> None:
    out = csv_lines(events).orderBy("time_group", *[F.asc_nulls_last(c) for c in ORDER[1:-1]], "event_id").select("line")
    out.write.mode("errorifexists").option("lineSep", "\r\n").text(path)


def timesketch(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, excluded): flat rows of events with a definite instant, and ids and reasons of the others."""
    e = with_key(events)
    rows = e.where("time_group = 1").select("event_id", "message", F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), (F.col("sec") * 1_000_000 + F.floor(F.col("nano") / 1000)).alias("timestamp"), F.col("time.kind").alias("timestamp_desc"), "source", "hostname")
    reason = F.when(F.col("time_group").isin(2, 3), "local time without a definite instant").when(F.col("time_group") == 4, "range").otherwise("unknown time")
    return rows, e.where("time_group > 1").select("event_id", reason.alias("reason"))


def case_lines(parts: dict[str, tuple[DataFrame, list[Column]]]) -> DataFrame:
    """(section, line) of a case: each part is a table with a column ``record`` of JSON text and its sort key."""
    out = None
    for name, (table, key) in parts.items():
        number = SECTIONS.index(name)
        line = F.concat(F.lit('{"record":'), F.col("record"), F.lit(f',"record_type":"{name}","schema_version":"1.0.0"}}'))
        own = table.select(F.lit(number).alias("section"), F.array(*[k.cast("string") for k in key]).alias("key"), line.alias("line"))
        out = own if out is None else out.unionByName(own)
    return out.orderBy("section", "key")


def _records(table: DataFrame, columns: list[str], key: list[Column]) -> tuple[DataFrame, list[Column]]:
    """A part of a case: each row as JSON text, beside its sort key. Attribute values, which are JSON texts, stand as what they are."""
    shown = [F.transform_values(c, lambda _, v: F.parse_json(v)).alias(c) if c == "attributes" else F.col(c) for c in columns]
    names = [f"__k{i}" for i in range(len(key))]
    return table.select(F.to_json(F.struct(*shown)).alias("record"), *[k.cast("string").alias(n) for k, n in zip(key, names, strict=True)]), [F.col(n) for n in names]


def case_parts(case_id: str, evidence: DataFrame, events: DataFrame, issues: DataFrame, matches: DataFrame | None = None, findings: DataFrame | None = None) -> dict[str, tuple[DataFrame, list[Column]]]:
    """The parts of a case in their order; the manifest, which counts the others, comes last."""
    spark = events.sparkSession
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 3).otherwise(4)
    moment = [F.lpad(F.coalesce(c.cast("string"), F.lit("~")), 20, "0") for c in (F.col("time_group"), F.col("sec"), F.col("nano"))]
    tables = {"evidence": (evidence, [F.col("source_locator")]), "event": (with_key(events), [*moment, F.coalesce("primary_text", F.lit("~")), F.coalesce("secondary_text", F.lit("~")), F.col("event_id")]), "issue": (issues, [F.col("evidence_id"), F.col("issue_code"), F.col("issue_message")])}
    if matches is not None:
        tables["match"] = (matches, [F.col("match_id"), F.array_join("evidence_ids", ",")])
    if findings is not None:
        tables["finding"] = (findings, [rank, F.col("finding_id")])
    parts = {"case": _records(spark.range(1).select(F.lit(case_id).alias("case_id")), ["case_id"], [F.col("case_id")])}
    parts |= {name: _records(table, events.columns if name == "event" else table.columns, key) for name, (table, key) in tables.items()}
    counts = manifest_counts(**{name: table for name, (table, _) in tables.items()})
    record = counts.agg(F.to_json(F.struct(F.lit(True).alias("complete"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("counts"))).alias("record"))
    parts["manifest"] = (record, [F.lit("")])
    return parts


def case_again(tables: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, list[Column]]]:
    """The parts of a case that was read, to be written again: the other records as they are, and a new manifest."""
    events = tables["event"]
    spare = tables["issue"].sparkSession.createDataFrame([], "issue_code string, issue_message string, evidence_id string")
    parts = case_parts("", spare.select(F.col("evidence_id").alias("source_locator")), events, spare)
    own = {n: tables[n].withColumn("__k0", F.coalesce(*[F.get_json_object("record", f"$.{k}") for k in keys])) for n, keys in {"case": ["case_id"], "evidence": ["source_locator"], "issue": ["evidence_id", "issue_code"], "match": ["match_id"], "finding": ["finding_id"]}.items()}
    parts |= {n: (t.select("record", "__k0"), [F.col("__k0"), F.col("record")]) for n, t in own.items()}
    counts = manifest_counts(**{n: events if n == "event" else tables[n] for n in ("event", "evidence", "finding", "issue", "match")})
    record = counts.agg(F.to_json(F.struct(F.lit(True).alias("complete"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("counts"))).alias("record"))
    return {n: parts[n] for n in SECTIONS if n in parts and n != "manifest"} | {"manifest": (record, [F.lit("")])}


def write_case_lines(path: str, parts: dict[str, tuple[DataFrame, list[Column]]]) -> None:
    """The case as JSON lines, an envelope a line, in files whose names are in order; the manifest is the last line of the last."""
    case_lines(parts).select("line").write.mode("errorifexists").text(path)


def write_case_json(path: str, parts: dict[str, tuple[DataFrame, list[Column]]]) -> None:
    """The case as one JSON document, record by record through the driver; the file must be new."""
    guard_output(path)
    plural = {"artifact": "artifacts", "event": "events", "issue": "issues", "match": "matches", "finding": "findings"}
    with open(path, "x", encoding="utf-8") as f:
        f.write('{"schema_version":"1.0.0"')
        for name, (table, key) in parts.items():
            f.write(f',"{plural.get(name, name)}":')
            alone = name in ("case", "manifest")
            f.write("" if alone else "[")
            for n, row in enumerate(table.orderBy(*key).select("record").toLocalIterator()):
                f.write(("," if n else "") + row["record"])
            f.write("" if alone else "]")
        f.write("}\n")


def manifest_counts(**tables: DataFrame) -> DataFrame:
    """One row (name, n) for each table."""
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in sorted(tables.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _page(title: str, tables: Iterable[tuple[str, list[str], Iterable]]) -> Iterable[str]:
    yield f'<!DOCTYPE html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src \'none\'; style-src \'unsafe-inline\'"><title>{pyhtml.escape(title)}</title></head><body><h1>{pyhtml.escape(title)}</h1>'
    for name, columns, rows in tables:
        yield f"<h2>{pyhtml.escape(name)}</h2><table><tr>" + "".join(f"<th>{pyhtml.escape(c)}</th>" for c in columns) + "</tr>"
        for r in rows:
            yield "<tr>" + "".join(f"<td>{pyhtml.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>"
        yield "</table>"
    yield "</body></html>\n"


def write_html(path: str, title: str, **tables: DataFrame) -> None:
    """A report for reading, row by row through the driver; the file must be new."""
    guard_output(path)
    with open(path, "x", encoding="utf-8") as f:
        f.writelines(_page(title, ((n, t.columns, t.toLocalIterator()) for n, t in tables.items())))


def write_text(path: str, **tables: DataFrame) -> None:
    guard_output(path)
    with open(path, "x", encoding="utf-8") as f:
        for name, t in tables.items():
            f.write(f"== {name}\n")
            for r in t.toLocalIterator():
                f.write("\t".join("" if v is None else "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in str(v)) for v in r) + "\n")


def guard_output(path: str, inputs: str | None = None) -> None:
    """No overwriting, no missing parent, no output within the input folder."""
    if os.path.exists(path):
        raise FileExistsError(path)
    if not os.path.isdir(os.path.dirname(os.path.abspath(path))):
        raise FileNotFoundError(os.path.dirname(path))
    if inputs and os.path.commonpath([os.path.realpath(inputs), os.path.realpath(path)]) == os.path.realpath(inputs):
        raise ValueError("the output lies within the input")
