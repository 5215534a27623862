"""The driver's contract holds with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q))"


def counted(folder: Path) -> list[int]:
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, check=True)
    return [int(x) for x in out.stdout.split()[-2:]]


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    n, ops = counted(tmp_path)
    assert n > 80 and ops == 0
