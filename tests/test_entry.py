"""The entry module without the corpus subpackage, in copies of the repository."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent

LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("keeps_pipeline", [True, False])
def test_entry_without_corpus_operators(tmp_path, keeps_pipeline):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if keeps_pipeline else ["corpus_pipeline.py"]))
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names, oracles = (line.split() for line in done.stdout.splitlines()[-2:])
    assert len(names) >= 58 and all(n.startswith("q_") for n in names)
    assert set(oracles) <= set(names)
