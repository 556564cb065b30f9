"""The driver's entry module imports, and registers every library query, without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIBRARY = ("postledger", "workloads", "__spark_entry__.py")


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_imports_without_training_data_folders(tmp_path, keep_pipeline):
    for name in LIBRARY + (("corpus_pipeline.py",) if keep_pipeline else ()):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    assert not (tmp_path / "postledger" / "llm").exists()
    probe = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(k for k in q if not k.startswith('q_')))"
    done = subprocess.run([sys.executable, "-c", probe], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    count, others = done.stdout.split(" ", 1)
    assert int(count) >= 48 and others.strip() == "[]"
