"""Driver contract: entry() and every registered query run on sf0.001."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["tenant_id", "dataset_id", "lines", "wrapped_lines", "stamped_lines", "bytes_in"]


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    assert len(df.columns) == len(set(df.columns))
