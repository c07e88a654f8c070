import pytest
from compare import DATA, connect, rows

from graphloom.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = rows(catalogue.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas().convert_dtypes())
    want = rows(con.execute(catalogue.ORACLES[name]).df().convert_dtypes())
    assert got == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
