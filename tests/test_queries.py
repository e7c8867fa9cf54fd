"""Every registered query against its SQL in a second engine."""

import os
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tallyfold.plans.catalog import QUERIES
from tools.compare import connect, differs

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries()) & set(oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert differs(spark, duck, name, SF_DIR) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["word", "docs", "doc_id", "tf"] and df.limit(1).count() == 1


def test_core_loads_without_an_optional_package():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(*sorted(e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert set(QUERIES) <= set(done.stdout.split())
