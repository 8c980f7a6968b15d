import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[2]
CODE = """
import __spark_entry__ as e
names = e.queries()
assert len(names) > 200 and not any(n.startswith('op') or n == 'pipeline' for n in names)
assert not any(n.startswith('op') or n == 'pipeline' for n in e.oracle_sql())
"""


@pytest.mark.parametrize("gone", [["kledger/llm", "tests/llm"], ["kledger/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_library_imports_without_this_subpackage(gone, tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(TOP, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or str((Path(folder) / n).relative_to(TOP)) in gone])
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, check=True)


def test_nothing_else_imports_it():
    own = [f for f in (TOP / "kledger").rglob("*.py") if "llm" not in f.parts]
    assert not [f for f in own if "kledger.llm" in f.read_text()]
