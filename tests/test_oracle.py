"""Every registered query of the reference against its DuckDB oracle at sf0.001."""

import os

import pytest

from oracle_check import compare, duck

from chronotok.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as ent

    con = duck(SF)
    _, status, _, detail, _ = compare(spark, con, name, ent.queries()[name], ent.oracle_sql()[name], SF)
    assert status == "OK", detail
