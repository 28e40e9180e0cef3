"""The driver contract with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

PRINT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print('NAMES', len(q), sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"


def names(folder):
    out = subprocess.run([sys.executable, "-B", "-c", PRINT], cwd=folder, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return next(line for line in out.stdout.splitlines() if line.startswith("NAMES"))


def test_entry_without_the_subpackage(tmp_path):
    left_out = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    found = names(tmp_path / "repo")
    assert found.endswith("[]") and int(found.split()[1]) > 90
    (tmp_path / "repo/wattline/llm/__pycache__").mkdir(parents=True)  # as a deleted folder may leave behind
    assert names(tmp_path / "repo") == found


def test_a_broken_dependency_is_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    (tmp_path / "repo/wattline/llm").mkdir()
    (tmp_path / "repo/wattline/llm/__init__.py").write_text("")
    (tmp_path / "repo/wattline/llm/queries.py").write_text("")
    (tmp_path / "repo/corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-B", "-c", PRINT], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
    assert out.returncode != 0 and "a_module_that_is_not_there" in out.stderr
