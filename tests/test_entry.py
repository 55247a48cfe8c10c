"""The driver's contract, with and without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

REPO = Path(__file__).resolve().parents[1]


def test_every_sql_belongs_to_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_the_rest_works_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "echofold"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "echofold/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op1') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_optional_part():
    for path in (REPO / "echofold").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "echofold.llm" not in path.read_text(), path
