"""Driver contract smoke test."""
import __spark_entry__ as ent


def test_entry_runs(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and "label" in df.columns


def test_oracle_keys_subset():
    qs, sql = ent.queries(), ent.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) > 100
