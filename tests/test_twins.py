"""Every query of the reference's operators against its SQL twin, over the smallest tables."""

import pytest

import verify
from ledgerlens.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_twin(spark, name):
    said = verify.compare(spark, verify.tables(SMALL), name, catalog.queries()[name], catalog.oracle_sql().get(name), SMALL)
    assert said.startswith(("equal", "rows"))


def test_registry_needs_no_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
