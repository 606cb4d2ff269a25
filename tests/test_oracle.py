"""Every bound query against its SQL twin."""

import pytest
from compare import compare
from conftest import FOLDER

from stopflow.operators import joins
from stopflow.plans import catalog

# Queries whose joins with an aggregate are also run beyond the broadcast bound.
JOINED = ["category_index", "delay_features"]


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    ok, message, _ = compare(spark, duck, FOLDER, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert ok, message


@pytest.mark.parametrize("name", JOINED)
def test_query_beyond_the_broadcast_bound(spark, duck, monkeypatch, name):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    ok, message, _ = compare(spark, duck, FOLDER, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert ok, message


def test_flagship(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).limit(1).count() == 1
