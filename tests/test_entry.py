"""The entry module, whole and without the corpus-preparation subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}).stdout.split()


def test_without_subpackage(tmp_path):
    shutil.copytree(ROOT / "docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "docloom/llm/__pycache__").mkdir(parents=True)
    found = names(tmp_path)
    assert "cosine_topk" in found and not any(n.startswith("op") or n == "pipeline" for n in found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 250
