"""The entry module without the optional subpackage, without a package it needs, and with a broken module in it."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sum(n.startswith('op') for n in q))"


@pytest.fixture
def copy(tmp_path):
    for name in ("tallywell", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    return tmp_path


def counted(folder: Path, before: str = "") -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-B", "-c", before + COUNT], cwd=folder, capture_output=True, text=True)


def test_without_the_subpackage(copy):
    (copy / "corpus_pipeline.py").write_text("from tallywell.llm import packing\n")
    queries, sql, optional = map(int, counted(copy).stdout.split())
    assert queries == sql > 60 and optional == 0


def test_without_a_package_that_only_the_subpackage_needs(copy):
    (copy / "tallywell" / "llm").mkdir()
    (copy / "tallywell" / "llm" / "__init__.py").write_text("")
    (copy / "corpus_pipeline.py").write_text("import a_package_that_is_not_there\n")
    queries, sql, optional = map(int, counted(copy).stdout.split())
    assert queries == sql > 60 and optional == 0


def test_a_broken_module_is_told(copy):
    (copy / "tallywell" / "llm").mkdir()
    (copy / "tallywell" / "llm" / "__init__.py").write_text("")
    (copy / "tallywell" / "llm" / "queries.py").write_text("from tallywell.sources.tables import no_such_name\n")
    (copy / "corpus_pipeline.py").write_text("")
    found = counted(copy)
    assert found.returncode and "no_such_name" in found.stderr
