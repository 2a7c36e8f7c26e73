"""Every registered query of the library's own operators against its SQL, at the smallest size."""

from __future__ import annotations

import compare
import pytest
from placelens.plans import catalog
from placelens.session import ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, duck, name):
    ship(spark)
    found = compare.difference(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLE[name])
    assert found in (None, "no rows on either side"), found


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    ship(spark)
    assert catalog.QUERIES[name](spark, SF).count() > 0
