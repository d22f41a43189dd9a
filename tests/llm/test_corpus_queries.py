"""The corpus queries against their SQL twins, and what they return."""

import pytest

from compare import connect, differ
from winnow.llm.oracles import ORACLES
from winnow.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert differ(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)
