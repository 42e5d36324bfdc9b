"""Every catalogue query against its SQL."""

import pytest

import __spark_entry__
from quireline import queries as catalogue


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(name, spark, sf_dir, duck, same):
    found = catalogue.queries()[name](spark, sf_dir).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(found) > 0
    else:
        same(found, duck.sql(sql).df())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
