"""The entry without the optional subpackage, or without a module that it needs."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["corpusgrep.llm", "corpus_pipeline", "tokenizers", "zstandard", "public_tokenizers"])
def test_missing_modules(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); "
            "print(len([n for n in q if not n.startswith('op') or n == 'output_order']), 'pipeline' in q, set(e.oracle_sql()) <= set(q))")
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=REPO, env=os.environ | {"PYTHONPATH": str(REPO)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, pipeline, fits = done.stdout.split()
    assert int(n) >= 80 and pipeline == "False" and fits == "True"
