"""Every query of the catalogue against its SQL twin, and the rest for rows."""

import pytest

from geostrata.plans import catalogue
from tests.harness import compare

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, name):
    assert compare(spark, DIR, catalogue.QUERIES[name], catalogue.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    got = catalogue.QUERIES[name](spark, DIR)
    assert got.columns and got.count() >= 0
