"""The driver contract: every registered query of the reference has oracle SQL that DuckDB can bind."""

import os

import pytest

from chronotok.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_registry_keys_match():
    import __spark_entry__ as ent

    assert set(QUERIES) == set(ORACLE) and len(QUERIES) >= 80
    assert set(QUERIES) <= set(ent.queries()) and set(ent.oracle_sql()) <= set(ent.queries())


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_oracle_sql_binds():
    import __spark_entry__ as ent
    from oracle_check import duck

    con = duck(SF)
    for sql in ent.oracle_sql().values():
        con.execute("EXPLAIN " + sql)  # raises on a binder/parser error
