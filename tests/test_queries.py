import pytest
from oracle import connect, differences

from corpusgraph.plans import queries, round_trips, sql

QUERIES, SQL = queries.QUERIES | round_trips.QUERIES, sql.SQL | round_trips.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    df = QUERIES[name](spark, tables)
    if name not in SQL:
        assert name == "conformance_report" and df.count() == 1  # its terms are those of conformance_terms
        return
    found, want = differences(df, connect(tables), SQL[name])
    assert found == want


def test_entry_and_registry(spark, tables):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["value", "count", "rank"]
