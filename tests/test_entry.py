"""The entry module with and without the parts that may be absent."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


def registered(folder: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True)
    return done.stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_training_data_subpackage(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "gaugeframe", copy / "gaugeframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", copy)
    own = [name for name in registered(ROOT) if name != "pipeline" and not name.startswith("op")]
    assert [name for name in registered(copy)] == own and len(own) > 100
