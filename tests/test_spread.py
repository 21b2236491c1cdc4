"""Costly steps over a table of one small file are dealt out to many tasks."""

import pytest

from tagloom import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["labels_erased", "label_masks", "settings_nested", "metadata_parsed", "workflows_edited"])
def test_more_than_one_task(spark, name):
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1
    assert registry.queries()[name](spark, SF).rdd.getNumPartitions() >= 4


def test_versions_round_halves_as_the_sql(spark, tmp_path):
    """Halves go to the even number."""
    import duckdb

    rows = [(i, f"2024-01-01 00:00:{i:02}", i % 5, "click", i + 0.5) for i in range(20)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("* except (ts)", "ts::timestamp AS ts").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    found = registry.queries()["versions_current"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(registry.oracle_sql()["versions_current"]).fetchall())
