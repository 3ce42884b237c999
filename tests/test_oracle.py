"""Every query with SQL gives the SQL's rows; the others give rows at all."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry
from tidepanel import catalog


LAST_PLACE = 1.000001e-6


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, connection, sf_dir, name):
    assert oracle.difference(spark, connection, name, sf_dir, LAST_PLACE) is None


def test_entry_summarises_both_sides(spark):
    rows = {row.split: row for row in entry.entry(spark).collect()}
    # Expected sizes of the smallest supplier panel.
    assert (rows["train"].n_rows, rows["test"].n_rows) == (559, 147)
    assert str(rows["test"].first_date) == "2000-09-01"
    assert rows["train"].last_date < rows["test"].first_date


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
