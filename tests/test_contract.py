import pytest

from siltstone.plans.contract import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["doc_contents_table", "doc_pages"])
def test_pages_of_empty_texts_equal_sql(spark, tmp_path, name):
    con, folder = connect(FOLDER), str(tmp_path)
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN doc_id % 6 = 1 OR doc_id % 10 = 4 THEN '' ELSE text END AS text) FROM documents) TO '{folder}/documents.parquet' (FORMAT parquet)")
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert compare(spark, con, folder, QUERIES[name], ORACLES[name])
