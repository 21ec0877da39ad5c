"""The engine's own operators: rule languages, ids, times, findings, scan, exports, and all registered SQL."""

import glob
import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chronospark.functions import ids, text, times
from chronospark.functions.canonical import dumps
from chronospark.operators import export, findings, scan, usn
from chronospark.plans import catalog, correlation, sigma, yaml
from chronospark.sources import evidence

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# YAML


@pytest.mark.parametrize(("source", "want"), [
    ("a: 1\nb:\n  - x: 1\n    y: [1, 'z', {q: 2}]\n  - 5\n", {"a": 1, "b": [{"x": 1, "y": [1, "z", {"q": 2}]}, 5]}),
    ("a: 'it''s'\nb: \"x\\n\\u0041\"\nc: foo:bar # no\nd: ~\ne: true\nf: 0o17\ng: 1.5\nh: -3\n", {"a": "it's", "b": "x\nA", "c": "foo:bar", "d": None, "e": True, "f": 15, "g": 1.5, "h": -3}),
    ("k:\n- a\n-\n  b: 1\n", {"k": ["a", {"b": 1}]}),
    ("", None),
    ("'a b': [x,\n  y]\n", {"a b": ["x", "y"]}),
])
def test_yaml(source, want):
    assert yaml.parse(source) == want


@pytest.mark.parametrize("source", ["a: &x 1", "a: *x", "a: !!str 1", "%YAML 1.2\n---\na: 1", "a: 1\n---\nb: 2", "a: |\n  x", "a: 1\na: 2", "\ta: 1", "a: [1", "a: 'x", "a: 1\n  b: 2", "a: b: c"])
def test_yaml_rejects(source):
    with pytest.raises(yaml.YamlError):
        yaml.parse(source)


# single-event rules


@pytest.mark.parametrize("condition", ["sel | count() > 5", "sel near other", "count(x) > 1", "%p%", "2 of sel*"])
def test_unsupported_conditions_skip_the_rule(condition):
    with pytest.raises(sigma.RuleError):
        sigma.Condition(condition)


def test_condition_precedence():
    assert sigma.Condition("a or b and not c").tree == ("or", ("sel", "a"), ("and", ("sel", "b"), ("not", ("sel", "c"))))


@pytest.mark.parametrize("detection", ["  sel:\n    User|re: x\n  condition: sel\n", "  sel:\n    - a\n  condition: sel\n", "  sel:\n    User: 1.5\n  condition: sel\n", "  condition: (\n", "  timeframe: 5m\n  condition: a\n"])
def test_wrong_rules(detection):
    with pytest.raises(sigma.RuleError):
        sigma.compile_rule(catalog._rule("x", detection))


def test_empty_quantifier_is_false(spark):
    rule = sigma.compile_rule(catalog._rule("x", "  sel:\n    User: a\n  condition: all of none*\n"))
    assert sigma.match(catalog.event_rows(spark, SF), [rule]).count() == 0


# sequence rules


@pytest.mark.parametrize("change", [("6h", "25h"), ("[user]", "[]"), ("[user]", "[nobody]"), ("severity: high", "severity: worst"), ("TF-CORR-001", "X"), ("within: 6h", "within: 06h"), ("base: 0.6", "base: 1.6"), ("  - event_type: purchase", "  - event_type: purchase\n    where: [{field: user, operator: eq, variable: nope}]")])
def test_wrong_sequences(change):
    with pytest.raises(correlation.RuleError):
        correlation.compile_rule(catalog.SEQ2.replace(*change))


def test_regular_expressions_outside_the_subset_never_match():
    assert correlation.java_pattern("(?=a)") is None and correlation.java_pattern("(a)\\1") is None and correlation.java_pattern("(") is None
    assert correlation.java_pattern("a$[$]\\$") == "(?Ud)a\\z[$]\\$"


def test_sequences_equal_backtracking(spark):
    rule = correlation.compile_rule(catalog.SEQ3.replace("24h", "7ms"))
    r = random.Random(3)
    base = catalog.event_rows(spark, SF)
    for _ in range(3):
        events = [(f"e{i:02d}", r.choice("ab"), r.choice(["view", "click", "purchase"]), r.randrange(3), r.randrange(25_000)) for i in range(40)]
        rows = spark.createDataFrame(events, "event_id string, user string, event_type string, k int, us long")
        rows = rows.select("event_id", "user", "event_type", F.lit("evtx").alias("source"), F.lit("observed").alias("assertion"), F.lit("h").alias("hostname"), F.create_map(F.lit("k"), F.col("k").cast("string")).alias("attributes"), F.struct(F.lit("utc_instant").alias("type"), F.lit(None).cast("long").alias("uncertainty_ms")).alias("time"), F.struct(F.lit("ev").alias("evidence_id")).alias("provenance"), F.lit(0).cast("long").alias("sec"), (F.col("us") * 1000).cast("int").alias("nano"))
        got = {tuple(x["ordered_event_ids"]) for x in correlation.match(rows, rule).collect()}
        want = {tuple(e[0] for e in c) for c in itertools.permutations(events, 3) if [e[2] for e in c] == ["view", "click", "purchase"] and len({e[1] for e in c}) == 1 and c[2][3] != c[0][3] and (c[0][4], c[0][0]) < (c[1][4], c[1][0]) < (c[2][4], c[2][0]) and (c[2][4] - c[0][4]) // 1000 <= 7 and (c[1][4] - c[0][4]) // 1000 <= 7}
        assert got == want
    assert base.count() > 0


def test_sequences_do_not_depend_on_partitions(spark):
    rule = correlation.compile_rule(catalog.CAPPED)
    events = catalog.event_rows(spark, SF)
    runs = [sorted(r["match_id"] for r in correlation.match(events.repartition(n), rule).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]


# ids, times, text


def test_ids_agree_with_the_driver(spark):
    got = one(spark, ids.match_id(F.lit("r"), F.lit("é"), F.array(F.lit("a"), F.lit(None).cast("string"))))
    assert got == ids.hashed("match", ["r", "é", 2, "a", None]) and one(spark, ids.valid_id(F.lit(got)))


def test_canonical_json():
    assert dumps({"b": 1, "a": [True, None, "é\n"]}) == '{"a":[true,null,"é\\n"],"b":1}'
    with pytest.raises(ValueError):
        dumps(float("nan"))


@pytest.mark.parametrize(("local", "zone", "want"), [("2024-03-10T02:30:00", "America/New_York", "nonexistent"), ("2024-11-03T01:30:00", "America/New_York", "ambiguous"), ("2024-07-01T12:00:00", "America/New_York", "single"), ("2024-04-07T01:45:00", "Australia/Lord_Howe", "ambiguous"), ("2024-06-07T01:45:00", "Australia/Lord_Howe", "single")])
def test_local_times(spark, local, zone, want):
    outcome, _ = times.local_to_utc(F.to_timestamp(F.lit(local), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))
    assert one(spark, outcome) == want


@pytest.mark.parametrize(("path", "key", "notes"), [("C:/A/../../b/.\\C", "c:\\b\\c", ["forward_slash_converted", "dot_component_removed", "parent_component_resolved", "parent_component_dropped_at_root", "comparison_key_case_folded"]), ("..\\x", "..\\x", ["parent_component_kept_relative"]), ("\\\\srv\\share\\\\f", "\\\\srv\\share\\f", []), ("", "", [])])
def test_windows_path(spark, path, key, notes):
    got = spark.range(1).select(*[c.alias(n) for c, n in zip(text.windows_path(F.lit(path)), "kn", strict=True)]).first()
    assert got["k"] == key and sorted(got["n"]) == sorted(notes)


def test_injection(spark):
    cells = ["=cmd()", "+1", "-1", "@x", "\tx", "  =x", "a,b", 'q"q', "l\nm", "plain", None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(text.csv_cell(F.col("c")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["'=cmd()", "'+1", "'-1", "'@x", "'\tx", "'  =x", '"a,b"', '"q""q"', '"l\nm"', "plain", ""]
    assert one(spark, text.html_attribute(F.lit("<a b='\"&\">"))) == "&lt;a b=&#39;&quot;&amp;&quot;&gt;"
    assert one(spark, text.escape_controls(F.lit("a\x1b[1m\x85\t"))) == "a^[[1m\\u0085\t"


# evidence, scan, findings


def test_discovery(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x").write_text("1")
    (tmp_path / "a").write_text("2")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    found = evidence.discover(str(tmp_path))
    assert [n for n, _ in found.files] == ["a", "b/x"] and found.symlinks == ["link"] and not found.truncated
    assert evidence.discover(str(tmp_path), max_files=1).truncated
    assert evidence.escape_name(b"a\xff\xc3\xa9") == "a%FFé"
    for bad in ("", "/a", "a/../b", "C:/x", "./a"):
        with pytest.raises(ValueError):
            evidence.normalize_locator(bad)


def test_contents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "z.zip").write_bytes(b"PK\x03\x04rest")
    rows = evidence.inspect(evidence.read_contents(spark, str(tmp_path))).collect()
    assert [(r["source_locator"], r["size"], r["kind"]) for r in rows] == [("d/z.zip", 8, "zip")]


@pytest.mark.parametrize("source", ['import "pe"\nrule a { condition: true }', "rule a { condition: foo }", "rule a { strings: $a = \"x\" condition: $b }", "include \"x\"", "nothing", "rule a {\n strings:\n  $a = /(?=x)/\n condition:\n  $a\n}"])
def test_wrong_scan_files(source):
    with pytest.raises(scan.ScanError):
        scan.compile_file(source)


def test_scan_conditions():
    (rule,) = scan.compile_file('rule a {\n strings:\n  $x = "A\\x42" wide ascii\n  $y = { 01 [2-3] ?F }\n  $z = /q+/i\n condition:\n  ($x and #z >= 2) or (all of ($y*) and not $z) and filesize < 1KB\n}\n')
    import re

    count = lambda data: {k: len(re.findall(p, data)) for k, p in rule.strings.items()}
    run = lambda data: scan.evaluate(rule, count(data), len(data))
    assert run(b"A\0B\0 q Q") and run(b"AB qq q") and run(b"\x01\x02\x03\x0f") and not run(b"\x01\x02\x0f") and not run(b"AB q")


def test_findings_are_lossless_and_first_group_wins(spark):
    m = catalog.single_matches(spark, SF, "sigma_exact", "sigma_one_of_wildcard")
    rules = [findings.MergeRule("b", ["rule-exact"], "B"), findings.MergeRule("a", ["rule-exact"], "A")]
    made = findings.build(m, rules)
    assert findings.lost(m, made).count() == 0 and made.where("title = 'A'").count() == (m.where("rule_id = 'rule-exact'").count() > 0) and made.where("title = 'B'").count() == 0


def test_techniques_of_a_bundle(spark, tmp_path):
    (tmp_path / "b.json").write_text(dumps({"type": "bundle", "objects": [{"type": "attack-pattern", "name": n, "external_references": [{"source_name": "mitre-attack", "external_id": "T1003"}], "kill_chain_phases": [{"kill_chain_name": "k", "phase_name": "p"}]} for n in ("Old", "New")] + [{"type": "x", "name": "y", "external_references": [], "kill_chain_phases": []}]}))
    rows = findings.stix_techniques(spark.read.json(str(tmp_path / "b.json"), multiLine=True)).collect()
    assert [tuple(r) for r in rows] == [("T1003", "New", "p")]


def test_paths_of_cycles_and_unknown_parents(spark):
    rows = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "zz", "C"), ("d", "e", "D"), ("e", "d", "E"), ("b", "a", "Z")], "id string, parent string, name string")
    got = {r["id"]: (r["path"], r["complete"]) for r in usn.resolve_paths(rows, "/", 4).collect()}
    assert got["b"] == ("A/B", True) and got["c"] == ("C", False) and not got["d"][1]


def test_outputs_are_guarded(spark, tmp_path):
    events = catalog.event_rows(spark, SF).limit(5)
    export.write_html(str(tmp_path / "r.html"), "T<", events=events.select("event_id", "message"))
    page = (tmp_path / "r.html").read_text()
    assert "T&lt;" in page and "&lt;" in page and "Content-Security-Policy" in page and page.count("<td>=user") == 5
    with pytest.raises(FileExistsError):
        export.write_html(str(tmp_path / "r.html"), "x")
    with pytest.raises(ValueError):
        export.guard_output(str(tmp_path / "in" / ".." / "new"), str(tmp_path))
    export.write_csv(events, str(tmp_path / "csv"))
    export.write_text(str(tmp_path / "t.txt"), events=events.select("event_id"))
    lines = export.case_lines({"event": (events.select("event_id", F.to_json(F.struct("event_id")).alias("record")), [F.col("event_id")]), "case": (spark.range(1).select(F.lit("{}").alias("record")), [F.lit("")])}).collect()
    assert lines[0]["section"] == 0 and len(lines) == 6
