"""The entry without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", ["nothing", "empty folder", "only compiled files", "no pipeline"])
def test_imports_without_the_optional_part(tmp_path, left):
    shutil.copytree(ROOT / "trailsift", tmp_path / "trailsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "empty folder":
        (tmp_path / "trailsift/llm").mkdir()
    if left == "only compiled files":
        (tmp_path / "trailsift/llm/__pycache__").mkdir(parents=True)
        (tmp_path / "trailsift/llm/__pycache__/queries.cpython-313.pyc").write_bytes(b"")
    if left == "no pipeline" and (ROOT / "trailsift/llm").exists():
        shutil.copytree(ROOT / "trailsift/llm", tmp_path / "trailsift/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
