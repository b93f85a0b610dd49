"""Every query with SQL gives the SQL's rows on the smallest tables."""

import pytest

from conftest import SMALL
from sparkloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, duck, same):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE_SQL:
        same(df, duck.sql(ORACLE_SQL[name]))
    else:
        assert df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
