"""Findings are told apart by their rule, and the union of the engines is what its SQL says."""

import os

import __spark_entry__
import duckdb
import pytest
from chronospark import analysis
from chronospark.operators import findings, scan
from chronospark.plans import catalog

SF = "/root/testdata/sf0.001"
BOTH = "the terms and more, licensed under x"


@pytest.fixture
def united(spark, tmp_path):
    """Rows of the query and of its SQL over the given documents and the small events."""

    def run(documents):
        os.symlink(f"{SF}/events.parquet", tmp_path / "events.parquet")
        spark.createDataFrame(documents, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'; CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        got = __spark_entry__.queries()["findings_union"](spark, str(tmp_path))
        return sorted(map(tuple, got.collect())), sorted(duck.sql(__spark_entry__.oracle_sql()["findings_union"]).fetchall())

    return run


def test_rules_of_one_file_make_findings_of_their_own(spark):
    contents = spark.createDataFrame([("e1", bytearray(BOTH.encode())), ("e2", bytearray(b"licensed under y"))], "evidence_id string, content binary")
    matches = analysis.byte_matches(contents, scan.compile_file(catalog.SCAN_RULES), 1 << 20)
    assert matches.count() == 3 and findings.single(matches).select("finding_id").distinct().count() == 3
    one = matches.where("array_contains(evidence_ids, 'e1')")
    groups = [findings.MergeRule(name, [name], name) for name in ("license_or_token", "two_of_three")]
    assert findings.build(one, groups).select("finding_id").distinct().count() == 2


def test_union_counts_rules_on_the_same_document(united):
    got, want = united([(1, BOTH), (2, "licensed under y"), (3, None)])
    assert got == want and ("YARA-X", 3, 3) in got


def test_union_holds_large_contents_and_documents_that_share_an_id(united):
    large = "x" * (1 << 20) + " licensed under z"
    got, want = united([(1, large), (2, "licensed under a"), (2, "licensed under b"), (None, "licensed under c"), (None, "licensed under d")])
    assert got == want and ("YARA-X", 5, 5) in got
