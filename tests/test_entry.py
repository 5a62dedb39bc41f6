"""The entry file without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_corpus_operators(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [
        n for n in names if n in (".git", "llm", "__pycache__", ".pytest_cache") or n == "corpus_pipeline.py" and not pipeline])
    found = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); assert not e.oracle_sql().keys() - e.queries().keys()"],
        cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert "fit_two_view" in found and not any(n == "pipeline" or n.startswith("op") and n[2].isdigit() for n in found)


def test_other_missing_modules_are_told(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "tests"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True)
    assert told.returncode and "no_such_module" in told.stderr
