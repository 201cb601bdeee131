"""The rest of the repository without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", [["corpus_pipeline.py"], []], ids=["pipeline left", "pipeline gone"])
def test_entry_imports_without_the_text_operators(tmp_path, left):
    for name in ["__spark_entry__.py", *left]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "hydrolens", tmp_path / "hydrolens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 71
