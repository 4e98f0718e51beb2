import pytest
from oracle import connect, differences

from corpusgraph.llm.queries import QUERIES
from corpusgraph.llm.sql import SQL

FOUND = {
    "p1_found": {"rec_id": "bigint", "lang": "string"}, "p2_found": {"rec_id_a": "bigint", "rec_id_b": "bigint"}, "p3_found": {"id1": "string", "field": "string", "term": "string"},
    "p4_found": {"kind": "string", "term": "string", "mark": "string"}, "p6_found": {"batch": "string", "rec_id": "bigint"}, "p8_found": {"doc_id": "bigint", "item_id": "bigint"}, "p9_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, tables)
    if name in FOUND:
        assert dict(df.dtypes) == FOUND[name] and df.count() == df.distinct().count()
    if name in SQL:
        found, want = differences(df, connect(tables), SQL[name])
        assert found == want
    else:
        assert df.count() > 0
