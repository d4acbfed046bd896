"""The rest of the library without the optional folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q) and 'touch' in q; print(len(q), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"


def copy_without(tmp_path, *gone):
    kept = shutil.ignore_patterns(".git", "__pycache__", "*.pyc")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda d, names: [n for n in names if os.path.relpath(os.path.join(d, n), ROOT) in gone or n in kept(d, names)])
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_imports_without_the_optional_folders(tmp_path):
    assert copy_without(tmp_path / "a", "rolecall/llm", "tests/llm", "corpus_pipeline.py")[1] == "False"
    assert copy_without(tmp_path / "b", "rolecall/llm", "tests/llm")[1] == "False"


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "rolecall")):
        if "llm" not in os.path.relpath(folder, ROOT).split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "rolecall.llm" not in f.read()
