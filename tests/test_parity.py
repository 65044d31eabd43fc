"""Every registered query against its SQL on the smallest test data."""

import parity
import pytest
from parity import entry


@pytest.fixture(scope="module")
def con(folder):
    return parity.duck(folder)


def test_every_query_has_sql():
    """Queries of the corpus subpackage may go without: their own tests compare them otherwise."""
    assert set(entry.queries()) - set(entry.CORPUS) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in entry.CORPUS])
def test_parity(spark, con, folder, name):
    _, _, difference = parity.compare(spark, con, name, folder)
    assert difference is None, difference


def test_entry(spark):
    assert entry.entry(spark).count() == 20
