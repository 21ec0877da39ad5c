"""From files to a case, and from the case to everything that reads one."""

import json
import os

import pytest
from chronospark import analysis, cli, config
from chronospark.plans import catalog
from chronospark.sources import case
from pyspark.sql import functions as F
from test_sources import hive, journal, link


@pytest.fixture
def place(tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.lnk").write_bytes(link())
    (files / "J").write_bytes(journal("old.txt"))
    (files / "SYSTEM").write_bytes(hive())
    (files / "note.txt").write_bytes(b"secret words")
    rules = tmp_path / "rules"
    rules.mkdir()
    (rules / "a.yml").write_text(catalog._rule("any", "  sel:\n    lnk.file_size: 5\n  condition: sel\n"))
    yara = tmp_path / "yara"
    yara.mkdir()
    (yara / "a.yar").write_text('rule words {\n strings:\n  $a = "secret"\n condition:\n  $a\n}\nrule header {\n strings:\n  $a = { 4C 00 00 00 }\n condition:\n  $a\n}\n')
    return tmp_path


def run(spark, *args):
    return cli.run([str(a) for a in args], spark)


def test_round_trip(spark, place, capsys):
    out = place / "out"
    assert run(spark, "analyze", place / "files", "--rules", place / "rules", "--yara-rules", place / "yara", "--yara-mode", "all", "--output", out) == 0
    tables = case.read_jsonl(spark, str(out / "case.jsonl"))
    n = {k: t.count() for k, t in tables.items()}
    assert n["case"] == n["manifest"] == 1 and n["evidence"] == 4 and n["event"] >= 4 and n["match"] == n["finding"] == 3
    manifest = json.loads(tables["manifest"].first()["record"])
    assert manifest == {"complete": True, "counts": {k: n[k] for k in ("event", "evidence", "finding", "issue", "match")}}
    lines = [json.loads(x) for p in sorted(os.listdir(out / "case.jsonl")) if p.startswith("part-") for x in (out / "case.jsonl" / p).read_text().splitlines()]
    kinds = [x["record_type"] for x in lines]
    assert kinds == sorted(kinds, key=["case", "evidence", "event", "issue", "match", "finding", "manifest"].index)
    events = [x["record"] for x in lines if x["record_type"] == "event"]
    assert any(e["attributes"].get("lnk.file_size") == 5 for e in events) and all(e["provenance"]["evidence_id"].startswith("tf-evidence-v1:") for e in events)
    capsys.readouterr()
    assert run(spark, "timeline", out) == 0 and capsys.readouterr().out.count("\n") == n["event"]
    assert run(spark, "sigma", out, "--rules", place / "rules") == 0 and capsys.readouterr().out.count("match_id") == 1
    assert run(spark, "export", out, "--format", "jsonl", "--output", place / "again.jsonl") == 0
    assert run(spark, "export", out, "--format", "json", "--output", place / "case.json") == 0
    assert run(spark, "export", out, "--format", "csv", "--output", place / "csv") == 0
    assert run(spark, "export", out, "--format", "html", "--output", place / "case.html") == 0 and "finding" in (place / "case.html").read_text()
    for again in (case.read_jsonl(spark, str(place / "again.jsonl")), case.read_json(spark, str(place / "case.json"))):
        assert {k: t.count() for k, t in again.items()} == n
        same = lambda t: {r["event_id"]: r["attributes"] for r in t.collect()}
        assert same(again["event"]) == same(tables["event"])


def test_modes_choose_evidence(spark, place, capsys):
    base = ("yara", place / "files", "--rules", place / "yara")
    assert run(spark, *base) == 0 and capsys.readouterr().out.count("rule_id") == 2
    assert run(spark, *base, "--mode", "explicit", "--evidence", "note.txt", "--evidence", "gone") == cli.EXIT["partial"]
    out = capsys.readouterr()
    assert out.out.count("rule_id") == 1 and "gone" in out.err
    assert run(spark, *base, "--mode", "suspicious") == cli.EXIT["usage"]
    assert run(spark, "analyze", place / "files", "--rules", place / "rules", "--output", place / "o") == 0
    capsys.readouterr()
    assert run(spark, *base, "--mode", "suspicious", "--case", place / "o") == 0
    found = capsys.readouterr().out
    assert found.count("rule_id") == 1 and "header" in found


def test_limits_leave_issues(spark, place):
    def codes(**limits):
        made = analysis.analyze(spark, str(place / "files"), config.load("") | {"limits": config.DEFAULTS["limits"] | limits}, {})
        return {r["issue_code"] for r in made.issues.collect()}, made

    assert codes()[0] == set()
    for limits, code in (({"max_files": 2}, "MAX-FILES"), ({"max_evidence_file_size_bytes": 50}, "MAX-EVIDENCE-FILE-SIZE-BYTES"), ({"max_snapshot_total_bytes": 200}, "MAX-SNAPSHOT-TOTAL-BYTES"), ({"max_events": 1}, "MAX-EVENTS")):
        found, made = codes(**limits)
        assert found == {f"TF-W-LIMIT-{code}"} and made.limited
    assert codes(max_events=1)[1].events.count() == 1
    (place / "strict.toml").write_text("[limits]\nmax_files = 2\n[strict]\nlimits = true\n")
    assert run(spark, "analyze", place / "files", "--config", place / "strict.toml", "--output", place / "s") == cli.EXIT["limits"]


def test_ids_must_be_distinct(spark):
    with pytest.raises(analysis.AnalysisError, match="e1"):
        analysis.checked_ids(spark.createDataFrame([("e1",), ("e1",), ("e2",)], "event_id string"))
    rows = spark.range(5)
    assert analysis.at_most(rows, 5, ["id"], "X")[1] is None
    kept, issue = analysis.at_most(rows, 3, [F.desc("id")], "X")
    assert [r["id"] for r in kept.collect()] == [4, 3, 2] and issue.first()["issue_code"] == "X"
