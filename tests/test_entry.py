import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e
import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_stands_without_the_training_data_part(tmp_path, pipeline):
    """A copy without the subpackage (and without or with the pipeline's file) gives its queries and SQL."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in ("llm", ".git", "__pycache__") or n == "corpus_pipeline.py" and not pipeline])
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    n, sql, has = done.stdout.split()
    assert int(n) >= int(sql) > 30 and has == "False"
