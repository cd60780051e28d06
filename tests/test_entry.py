"""The driver's entry with and without the optional operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[1]
SHOW = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(*q)"


def names(folder):
    return subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_without_the_optional_operators(tmp_path):
    for name in ("plumbline", "__spark_entry__.py"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    got = names(tmp_path)
    assert "missing_ack_by_claim" in got and not any(n.startswith("op") and "_" in n and n[2:3].isdigit() for n in got)
    assert set(got) <= set(names(REPO))


def test_nothing_else_imports_them():
    for path in (REPO / "plumbline").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
