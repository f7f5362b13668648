"""Every query that SQL can express against its SQL, over whole tables."""

import pytest
from conftest import SF
from oracle import differences

from lexmill.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), ORACLE_SQL[name], con) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
