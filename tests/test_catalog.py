"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest

from quillforge.plans import catalog, catalog_artifacts, catalog_documents, catalog_more, catalog_scans

SF = "/root/testdata/sf0.001"
assert catalog_more and catalog_scans and catalog_documents and catalog_artifacts


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    frame = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        assert oracle.differences(frame, con, catalog.SQL[name]) == ""
    else:
        assert frame.count() >= 0 and len(set(frame.columns)) == len(frame.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
