"""Every operation runs; those with an SQL text give the same rows, names and types."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from sievework import registry

from . import oracle

OPERATIONS = registry.operations()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(OPERATIONS))
def test_operation(spark, sf_dir, con, name):
    op = OPERATIONS[name]
    df = op.runner(spark, sf_dir)
    if op.sql:
        assert oracle.differences(df, con, op.sql) == []
    else:
        assert df.count() >= 0


def test_entry_points_agree(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() == 1


def test_unknown_operation_lists_known_ones(spark, sf_dir):
    with pytest.raises(KeyError, match="scorecard"):
        registry.run("no such thing", spark, sf_dir)


def test_every_operation_is_described():
    assert all(op.description and op.covers for op in OPERATIONS.values())


def test_listing_names_every_operation(spark):
    assert {r["name"] for r in registry.listing(spark).collect()} == set(OPERATIONS)
