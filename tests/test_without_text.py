"""The library loads and registers its queries when the text operators (and their pipeline) are removed."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
PROBE = "import __spark_entry__ as d; q = d.queries(); o = d.oracle_sql(); print(len(q), len(o), any(k.startswith('op') for k in q))"


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_loads_without_text_operators(tmp_path, keep_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md"))
    assert not (copy / "granary" / "llm").exists() and not (copy / "tests" / "llm").exists()
    if not keep_pipeline:
        (copy / "corpus_pipeline.py").unlink()
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    n_queries, n_sql, text = out.stdout.split()
    assert int(n_queries) > 100 and int(n_sql) > 100 and text == "False"
    # the oracle test module imports as well
    out = subprocess.run([sys.executable, "-c", "import tests.test_oracle"], cwd=copy, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
