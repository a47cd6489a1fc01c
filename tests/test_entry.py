import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

CODE = """
import __spark_entry__ as e
from lodeseek.catalog.expected import EXPECTED
from lodeseek.catalog.queries import QUERIES
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(EXPECTED)
"""


def copied(tmp_path, *without):
    """The repository without some of its files."""
    ignore = shutil.ignore_patterns(".git", "__pycache__", *without)
    return shutil.copytree(REPO, tmp_path / "copy", ignore=ignore)


def imported(root):
    return subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True)


def test_entry_without_the_training_operators(tmp_path):
    done = imported(copied(tmp_path, "llm"))
    assert done.returncode == 0, done.stderr


def test_entry_without_them_and_the_pipeline(tmp_path):
    done = imported(copied(tmp_path, "llm", "corpus_pipeline.py"))
    assert done.returncode == 0, done.stderr


def test_entry_hides_no_other_fault(tmp_path):
    root = copied(tmp_path)
    module = root / "lodeseek" / "workspace.py"
    module.write_text(module.read_text() + "\nimport a_module_that_is_not_there\n")
    assert "a_module_that_is_not_there" in imported(root).stderr
