import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


def test_core_does_not_import_the_optional_subpackage():
    code = "import sys, tarazu.plans.registry as r; r.queries(); r.oracle_sql(); assert not [m for m in sys.modules if m.startswith('tarazu.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_flagship(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and "n" in got.columns
