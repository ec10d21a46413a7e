"""Every registered query against its SQL, on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
import check

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return check.database(ROOT)


@pytest.mark.parametrize("name", list(entry._QUERIES))
def test_query(spark, con, name):
    assert check.compare(spark, con, name, ROOT).startswith(("ok", "rows"))


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_only_documents_lack_sql():
    missing = set(entry._QUERIES) - set(entry.oracle_sql())
    assert missing == {"dash_all", "rev_bundle", "dash_top5_views", "export_report"}
    assert not set(entry.oracle_sql()) - set(entry.queries())
