"""The entry module, with and without the text part."""

import shutil
import subprocess
import sys
from pathlib import Path

from lumaframe.queries import QUERIES, SQL

REPO = Path(__file__).resolve().parent.parent


def listed(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *sorted(e.queries()))"
    found = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    n, sql, *names = found.stdout.split()
    return int(n), int(sql), names


def test_entry_without_the_text_part(tmp_path):
    for keep in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / keep).exists():
            shutil.copy(REPO / keep, tmp_path)
    shutil.copytree(REPO / "lumaframe", tmp_path / "lumaframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert listed(tmp_path) == (len(QUERIES), len(SQL), sorted(QUERIES))
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed(tmp_path)[2] == sorted(QUERIES)


def test_entry_of_the_whole():
    names = listed(REPO)[2]
    assert {*QUERIES} <= {*names}
