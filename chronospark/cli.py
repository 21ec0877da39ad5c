"""Commands: analyze, timeline, correlate, sigma, yara, export, rules, inspect, version."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__, config

#: Exit codes by meaning; of several the most severe counts.
EXIT = {"ok": 0, "partial": 1, "usage": 2, "input": 3, "rules": 4, "limits": 5, "output": 6, "internal": 10}
SEVERE = ("ok", "partial", "rules", "limits", "input", "output", "usage", "internal")


def worse(a: str, b: str) -> str:
    return max(a, b, key=SEVERE.index)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronospark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        return c

    command("analyze", "input", "--output", "--config", "--rules", "--yara-rules", "--correlations").add_argument("--yara-mode", choices=("all", "suspicious", "explicit"))
    t = command("timeline", "case", "--from", "--to")
    t.add_argument("--type", action="append")
    t.add_argument("--host", action="append")
    command("correlate", "case", "--rules", "--output")
    command("sigma", "case", "--rules", "--output")
    y = command("yara", "input", "--rules", "--output")
    y.add_argument("--mode", default="all", choices=("all", "suspicious", "explicit"))
    y.add_argument("--case", help="suspicious: evidence that this case's matches name")
    y.add_argument("--evidence", action="append", default=[], help="explicit: an evidence id or a locator")
    command("export", "case", "--output").add_argument("--format", default="text", choices=("text", "json", "jsonl", "csv", "html", "timesketch"))
    r = command("rules", "rules")
    r.add_argument("--kind", default="sigma", choices=("sigma", "correlation", "yara"))
    command("inspect", "input")
    command("version")
    return p


def _case(spark, path: str):
    from .sources import case

    if os.path.isdir(path) and os.path.exists(os.path.join(path, "case.jsonl")):  # what analyze has written
        path = os.path.join(path, "case.jsonl")
    return (case.read_jsonl if path.rstrip("/").endswith(".jsonl") else case.read_json)(spark, path)


def _emit(df, output: str | None, order: list[str]) -> int:
    out = df.orderBy(*order)
    if output:
        out.write.mode("errorifexists").json(output)
        return out.count()
    n = 0
    for row in out.toJSON().toLocalIterator():
        print(row)
        n += 1
    return n


def run(args: list[str], spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        print(__version__)
        return EXIT["ok"]
    if a.command == "rules":
        from .sources import rules

        files, skipped = rules.load(a.rules)
        compiled, bad = rules.compile_all(files, a.kind)
        for name, reason in [*bad, *((s, "too large") for s in skipped)]:
            print(f"{name}: {reason}", file=sys.stderr)
        print(f"{len(compiled)} rules")
        return EXIT["rules" if bad or skipped else "ok"]
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from pyspark.sql import functions as F

    from . import analysis
    from .functions import ids
    from .operators import export, findings, scan, timeline
    from .plans import correlation, sigma
    from .sources import evidence, rules

    status = "ok"
    if a.command == "inspect":
        _emit(evidence.inspect(evidence.read_contents(spark, a.input)), None, ["source_locator"])
    elif a.command == "yara":
        compiled, bad = rules.compile_all(rules.load(a.rules)[0], "yara")
        status = worse(status, "rules" if bad else "ok")
        contents = evidence.with_ids(evidence.read_contents(spark, a.input)).withColumn("status", F.lit("verified_snapshot"))
        wanted = None
        if a.mode == "suspicious":
            if not a.case:
                print("--mode suspicious needs --case", file=sys.stderr)
                return EXIT["usage"]
            wanted = _case(spark, a.case)["match"].select(F.explode(F.from_json(F.get_json_object("record", "$.evidence_ids"), "array<string>")).alias("evidence_id")).distinct()
        elif a.mode == "explicit":
            given = spark.createDataFrame([(x,) for x in a.evidence], "evidence_id string")
            by_name = contents.select("source_locator", F.col("evidence_id").alias("found"))
            wanted = given.join(by_name, given.evidence_id == by_name.source_locator, "left").select(F.coalesce("found", "evidence_id").alias("evidence_id"))
        chosen, lost = evidence.select_mode(contents, a.mode, wanted)
        for row in lost.collect() if lost is not None else []:  # ids that the caller gave, or that the case names
            print(f"no such evidence: {row['evidence_id']}", file=sys.stderr)
            status = worse(status, "partial")
        _emit(scan.scan(chosen, compiled), a.output, ["evidence_id", "rule_sha256", "rule_id"])
    elif a.command == "analyze":
        settings = config.load(open(a.config, encoding="utf-8").read() if a.config else "")
        settings["yara"]["mode"] = a.yara_mode or settings["yara"]["mode"]
        compiled, limits = {}, settings["limits"]
        for kind, folder in (("sigma", a.rules), ("correlation", a.correlations), ("yara", a.yara_rules)):
            if folder and settings[kind]["enabled"]:
                files, skipped = rules.load(folder)
                files = [f for f in files if len(f.data) <= limits["max_rule_file_size_bytes"]][: limits["max_rule_files"]]
                compiled[kind], bad = rules.compile_all(files, kind)
                status = worse(status, "rules" if bad or skipped else "ok")
                if bad and settings["strict"]["rules"]:
                    return EXIT["rules"]
        made = analysis.analyze(spark, a.input, settings, compiled, f"{a.output}/work" if a.output else None)
        broken = made.issues.where(~F.col("issue_code").startswith("TF-W-LIMIT-")).limit(1).count() > 0
        status = worse(status, "input" if broken and settings["strict"]["parser"] else "partial" if broken else "ok")
        status = worse(status, "limits" if made.limited and settings["strict"]["limits"] else "partial" if made.limited else "ok")
        if a.output:
            case_id = made.evidence.agg(ids.case_id(F.collect_set("evidence_id")).alias("c")).first()["c"]
            export.write_case_lines(f"{a.output}/case.jsonl", export.case_parts(case_id, made.evidence, made.events, made.issues, made.matches, made.findings))
            timeline.ordered(made.events).write.mode("errorifexists").json(f"{a.output}/events")
            made.issues.write.json(f"{a.output}/issues")
            if made.matches is not None:
                made.matches.write.json(f"{a.output}/matches")
                findings.ordered(made.findings).write.json(f"{a.output}/findings")
        else:
            _emit(made.events.select("event_id", "event_type", "time.value", "message"), None, ["value", "event_id"])
    else:
        tables = _case(spark, a.case)
        events = tables["event"]
        if a.command == "timeline":
            found = timeline.filtered(events, getattr(a, "from"), a.to, a.type, a.host)
            _emit(found.select(*timeline.ORDER, "event_type", "hostname", "message"), None, timeline.ORDER)
        elif a.command in ("sigma", "correlate"):
            compiled, bad = rules.compile_all(rules.load(a.rules)[0], "sigma" if a.command == "sigma" else "correlation")
            status = worse(status, "rules" if bad else "ok")
            found = [sigma.match(events, compiled)] if a.command == "sigma" else [correlation.match(timeline.with_instants(events, r.allow_uncertain), r) for r in compiled]
            for i, f in enumerate(found):
                _emit(f, f"{a.output}/{i}" if a.output else None, ["match_id"])
        elif a.format == "csv":
            export.write_csv(events, a.output)
        elif a.format == "timesketch":
            rows, excluded = export.timesketch(events)
            rows.orderBy("timestamp", "event_id").drop("event_id").write.mode("errorifexists").json(a.output)
            status = worse(status, "partial" if excluded.limit(1).count() else "ok")
        elif a.format in ("jsonl", "json"):
            (export.write_case_lines if a.format == "jsonl" else export.write_case_json)(a.output, export.case_again(tables))
        else:
            shown = {"events": events.select("event_id", "event_type", "time.value", "message")}
            shown |= {name: tables[name].orderBy("record") for name in ("evidence", "issue", "match", "finding", "manifest")}
            (export.write_html if a.format == "html" else export.write_text)(a.output, **({"title": "Case"} if a.format == "html" else {}), **shown)
    return EXIT[status]


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
