import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_columns_are_those_of_the_sql(spark):
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{folder}/{f}')")
    for name in ("pause_patterns", "appearance_sessions", "track_summary", "retention_plan", "linear_cuts"):
        want = con.execute(entry.oracle_sql()[name]).fetchdf()
        got = entry.queries()[name](spark, folder)
        assert sorted(got.columns) == sorted(want.columns) and got.count() == len(want)
