import duckdb
import pytest

from lodestone.plans import file_queries, queries, reading_queries

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n, f in queries.queries().items() if f.__module__ in (file_queries.__name__, reading_queries.__name__)] + ["srch_09_empty_query", "imp_01_semi_join"]


@pytest.mark.parametrize("name", NAMES)
def test_a_written_file_opens_as_its_table(spark, name):
    sql = duckdb.connect()
    for t in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        sql.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    found = queries.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = sql.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == sorted(want) != []
