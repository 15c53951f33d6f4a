"""The entry imports, and lists all other queries, where the training-data part is absent."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


@pytest.mark.parametrize("gone", [["motionframe/llm", "tests/llm"], ["motionframe/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_part(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in gone:
        place = copy / name
        shutil.rmtree(place) if place.is_dir() else place.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    listed, checked, extra = out.stdout.split()
    assert int(listed) >= 200 and int(checked) > 180 and extra == "False"
