"""Every query against its SQL on the smallest tables."""

import os

import pytest

from oracle import difference
from tidewick import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    query = catalogue.QUERIES[name]
    if name in catalogue.ORACLES:
        assert difference(spark, SF, query, catalogue.ORACLES[name]) == ""
    else:
        rows = query(spark, SF).collect()  # no SQL: it runs, and gives no row twice
        assert len({str(r) for r in rows}) == len(rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "doc_id" not in entry.entry(spark).columns
