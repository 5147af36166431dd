"""Every query of the library against its SQL, on the smallest tables."""

import compare
import pytest
from pagewright.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    con = compare.connect(small)
    assert compare.differences(spark, con, queries.QUERIES[name], oracles.ORACLES[name], small) == ""


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql_gives_rows(small, name):
    assert compare.connect(small).execute(f"select count(*) from ({oracles.ORACLES[name]})").fetchone()[0] > 0 or name == "c13_spelling_variants"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
