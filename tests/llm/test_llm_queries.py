"""Queries of the llm operators against their SQL over whole tables, and the rest for shape."""

import pytest
from conftest import SF
from oracle import differences

from lexmill.llm.queries import ORACLE_SQL, QUERIES

FOUND = {
    "p1_found": ["rid", "term"],
    "p2_found": ["rid", "kind", "start_pos"],
    "p4_found": ["rid"],
    "p5_found": ["rid", "markup"],
    "p6_found": ["rid_first", "rid_copy"],
    "p7_found": ["rid", "kind"],
    "p8_ids": ["doc_id", "ids"],
    "p10_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), ORACLE_SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_no_repeats(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == FOUND[name]
    assert df.count() == df.distinct().count() > 0
