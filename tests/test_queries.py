"""Every registered query against its SQL on the smallest tables; entry points without the optional part."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences
from tidemark import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name not in catalog.ORACLE_SQL:
        assert catalog.QUERIES[name](spark, SF).count() > 0
    else:
        assert differences(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], con) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_import_without_the_optional_part(tmp_path):
    for p in ["__spark_entry__.py", *[str(x.relative_to(ROOT)) for x in (ROOT / "tidemark").rglob("*.py") if "llm" not in x.parts]]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text((ROOT / p).read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))], out.stderr
