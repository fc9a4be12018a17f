"""Every registered query of the core against its SQL oracle, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from graphloom import catalog

from .oracle_check import compare

SF = "/root/testdata/sf0.001"
#: Queries without a row on the smallest tables: no ring, no large quantity of a poor supplier.
NOTHING = {"trade_rings", "smells", "ceiling_rule", "acyclic_contract"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", catalog.ORACLES)
def test_oracle(spark, name):
    assert compare(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name]) == ("no rows" if name in NOTHING else "")


def test_entry_has_all():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
