"""Every query that has SQL gives the same rows as that SQL."""

import pytest
from rows import same

from responsa.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, data, name):
    assert not (diff := same(QUERIES[name](spark, data), duck.execute(ORACLES[name]).fetchdf())), diff
