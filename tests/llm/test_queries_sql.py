"""Queries against their SQL on the smallest tables."""

import pytest

from arborix.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLE[name])
