"""The entry point in copies of the library that lack the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n == 'pipeline' or n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_corpus_folders(tmp_path, pipeline):
    shutil.copytree(ROOT / "loomlog", tmp_path / "loomlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    queries, oracles, corpus = map(int, said.stdout.split())
    assert queries == oracles > 100 and corpus == 0
