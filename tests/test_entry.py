"""The entry module works without the training-data package."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {repo!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("traceloom.llm"):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 30 and set(e.oracle_sql()) <= set(e.queries())
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""


def test_without_the_training_data_package():
    subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO))], check=True)


def test_no_other_module_imports_it():
    for path in (REPO / "traceloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "traceloom.llm" not in path.read_text()
