import pytest

import __spark_entry__ as entry
from evidentia.plans import reference, training
from tests.oracle import connect, rows

CORE = {**reference.queries(), **training.queries()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, name):
    got = CORE[name](spark, sf).toPandas()
    sql = reference.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    assert rows(got) == rows(connect(sf).sql(sql).df())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
