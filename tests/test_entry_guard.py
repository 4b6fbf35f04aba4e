"""The entry module and its queries without the optional subpackage."""
import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries()))"


def _keys(folder):
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    return set(out.stdout.split())


def test_entry_imports_without_the_subpackage(tmp_path):
    """With the folder gone, whether the pipeline file is left behind or not, all other queries load."""
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "tests", ".pytest_cache")
    shutil.copytree(HERE, tmp_path / "left", ignore=skip)
    left = _keys(tmp_path / "left")
    assert "eval_pooled" in left and "pipeline" not in left and not any(k.startswith("op1") for k in left)
    gone = shutil.ignore_patterns(".git", "llm", "__pycache__", "tests", ".pytest_cache", "corpus_pipeline.py")
    shutil.copytree(HERE, tmp_path / "gone", ignore=gone)
    assert _keys(tmp_path / "gone") == left
    with_all = _keys(HERE)
    assert left <= with_all
