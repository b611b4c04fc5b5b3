"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks.compare import compare
from checks.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert name in ORACLES
    assert compare(spark, name, sf_dir) is None
