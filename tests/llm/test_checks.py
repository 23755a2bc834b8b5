import pytest
from cases import SMALL
from parity import compare, connect

from apexline.llm.checks import CHECKS
from apexline.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), CHECKS[name]) == ""
