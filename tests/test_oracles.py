import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, duck, folder, name):
    good, note = compare(spark, duck, name, folder)
    assert good, note


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert [row["rank"] for row in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
    assert rows
