"""The driver contract holds without the corpus folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder: str) -> list[str]:
    code = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": folder})
    assert run.returncode == 0, run.stderr
    return run.stdout.rpartition("NAMES")[2].split()


def test_entry_without_corpus_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, found: [x for x in found if x in (".git", "llm", "__pycache__", ".pytest_cache")])
    left = names(str(copy))
    assert len(left) > 180 and "r1_mlr_accuracy" in left and "pipeline" not in left and not any(n.startswith("op9_") for n in left)
    assert (copy / "fleetcast" / "plans").is_dir() and not (copy / "fleetcast" / "llm").exists()
