"""Every registered query against its SQL, on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")

spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    assert compare(tables, entry.queries()[name](spark, SF_DIR), entry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
