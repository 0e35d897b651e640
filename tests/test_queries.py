"""Every registered query against its SQL on the smallest tables; those without SQL must run and give rows."""

from __future__ import annotations

import pytest

from furrow.plans.registry import COVERS, ORACLES, QUERIES
from tests.conftest import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    assert len(df.toPandas())


def test_every_query_names_what_it_covers():
    assert set(COVERS) == set(QUERIES)
    assert all(COVERS.values())
