"""Sequence queries return every match that their SQL returns, beyond the default cap of a rule."""

from datetime import datetime, timedelta

import __spark_entry__
import duckdb


def test_more_matches_than_the_default_cap(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i), 1, "view" if i < 400 else "purchase", 1.0, '{"k": 1}') for i in range(800)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("corr_seq2_user", "corr_max_matches"):
        got = __spark_entry__.queries()[name](spark, str(tmp_path)).count()
        assert got == duck.sql(f"SELECT count(*) FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()[0][0]
        assert got == 25 if name == "corr_max_matches" else got > 100_000
