"""Every query of the subpackage against its SQL, on the smallest tables."""

import compare
import pytest
from pagewright.llm.oracles import ORACLES
from pagewright.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    assert compare.differences(spark, compare.connect(small), QUERIES[name], ORACLES[name], small) == ""


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
