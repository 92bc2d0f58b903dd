"""The library without its subpackage for training data."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_subpackage(tmp_path):
    for gone in (("corpusmith/llm",), ("corpusmith/llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(gone))
        shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", ".pytest_cache"))
        for g in gone:
            p = copy / g
            shutil.rmtree(p, ignore_errors=True) if p.is_dir() else p.unlink(missing_ok=True)
        code = "import __spark_entry__ as e; n = set(e.queries()); assert n and not [x for x in n if x.startswith('op') and x[2].isdigit()] and 'pipeline' not in n; assert set(e.oracle_sql()) <= n"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
