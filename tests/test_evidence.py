"""Snapshots, byte limits, probes and first-seen names: what counts, and in which order."""

import duckdb
import pytest
from chronospark.operators import usn
from chronospark.plans import catalog
from chronospark.sources import evidence
from chronospark.sources.parsers import base, parse_one
from chronospark.storage import numbered


@pytest.mark.parametrize("parts", [1, 4])
def test_evidence_that_does_not_fit_is_passed_over(spark, parts):
    sizes = [6, 100, 3, 5, 1, 2]
    rows = spark.createDataFrame([(f"f{i}", f"e{i}", n) for i, n in enumerate(sizes)], "source_locator string, evidence_id string, size long").repartition(parts)
    got = [(r["running"], r["within"]) for r in sorted(evidence.running_bytes(rows, 10).collect(), key=lambda r: r["source_locator"])]
    assert got == [(6, True), (106, False), (9, True), (14, False), (10, True), (12, False)]
    assert evidence.running_bytes(rows.limit(0), 10).count() == 0


def test_byte_limit_equals_a_plain_fold(spark):
    sizes = [(i * 7919) % 101 + 1 for i in range(400)]
    rows = spark.createDataFrame([(f"{i:04d}", str(i), n) for i, n in enumerate(sizes)], "source_locator string, evidence_id string, size long").repartition(7)
    for limit in (50, 3000, 10**6):
        total, want = 0, set()
        for i, n in enumerate(sizes):
            if total + n <= limit:
                total += n
                want.add(str(i))
        assert {r["evidence_id"] for r in evidence.running_bytes(rows, limit).where("within").collect()} == want


def test_global_numbers(spark):
    rows = spark.range(1000).selectExpr("id", "(id * 37) % 1009 AS k").repartition(5)
    assert [r["id"] for r in sorted(numbered(rows, ["k"]).collect(), key=lambda r: r["place"])] == sorted(range(1000), key=lambda i: i * 37 % 1009)
    assert sorted(r["place"] for r in numbered(rows, ["k"]).collect()) == list(range(1, 1001))
    assert numbered(rows.limit(0), ["k"]).count() == 0


def test_probes_decide_what_is_parsed(monkeypatch):
    assert base.resolve({"lnk": "confirmed", "evtx": "not_this_format"}) == (["lnk"], None)
    assert base.resolve({"lnk": "confirmed", "evtx": "malformed"}) == ([], "TF-W-PROBE-MALFORMED")
    assert base.resolve({"lnk": "confirmed", "evtx": "confirmed"}) == ([], "TF-W-PROBE-AMBIGUOUS")
    assert base.resolve({"amcache": "confirmed", "registry": "confirmed"}) == (["amcache", "registry"], None)
    assert base.resolve({"jump_list": "probable", "evtx": "not_this_format"}) == (["jump_list"], "TF-W-PROBE-PROBABLE-ONLY")
    monkeypatch.setattr(base, "probe", lambda data, locator: {"lnk": "confirmed", "evtx": "malformed"})
    (row,) = parse_one(b"x", "a")
    assert row["issue_code"] == "TF-W-PROBE-MALFORMED" and row["provenance"]["source_locator"] == "a" and row["provenance"]["evidence_id"]


def test_first_seen_name_and_close_renames(spark):
    nodes = spark.createDataFrame([("a", None, "", 0), ("a", None, "zeta", 1), ("a", None, "alpha", 2), ("b", "a", "x", 3)], "id string, parent string, name string, seen int")
    assert {r["id"]: r["path"] for r in usn.resolve_paths(nodes, "/", order="seen").collect()} == {"a": "zeta", "b": "zeta/x"}
    records = [(1, 1, "old", "f", "a", 10), (1, 2, "new", "f", "b", 11), (1, 3, "old", "f", "a", 20), (1, 4, "new", "f", "b", 22), (1, 5, "old", "f", None, 30), (1, 6, "new", "f", "b", 30)]
    rows = spark.createDataFrame(records, "j int, n int, reason string, file string, name string, usn long")
    assert [r["first"] for r in usn.rename_pairs(rows, ["j"], ["n"], "old", "new", name="name", usn="usn").collect()] == [1]


def test_snapshots_are_verified(spark):
    before = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], "source_locator string, size long, sha256 string")
    after = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y"), ("e", 1, "x")], "source_locator string, size long, sha256 string")
    got = {r["source_locator"]: (r["status"], r["issue"]) for r in evidence.verify_snapshot(before, after).collect()}
    assert got == {"a": ("verified_snapshot", None), "b": ("snapshot_failed", "TF-W-SNAPSHOT-SIZE"), "c": ("snapshot_failed", "TF-W-SNAPSHOT-HASH"), "d": ("snapshot_failed", "TF-W-SNAPSHOT-MISSING")}


def test_renames_occur_in_the_data():
    c = duckdb.connect()
    c.sql("create view events as select * from '/root/testdata/sf0.01/events.parquet'")
    assert 0 < c.sql(f"select count(*) from ({catalog.oracle_sql()['rename_distance']})").fetchall()[0][0]
