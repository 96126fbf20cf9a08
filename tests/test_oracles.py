"""Every bound query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from bindings import QUERIES
from haulgrid.session import released
from tools.check_oracles import TABLES, compare

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    with released(spark):
        assert compare(spark, con, DATA, name, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
