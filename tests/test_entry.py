import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    code = "import sys; sys.modules['gridloom.llm'] = None; import __spark_entry__ as e; assert e.queries(); assert not [q for q in e.queries() if q.startswith('p1_')]; assert not [m for m in sys.modules if m.startswith('gridloom.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "page_id", "rank"] and rows.count() > 0
