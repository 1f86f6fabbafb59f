"""The rest of the library does not need the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_import_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "tidecast", tmp_path / "tidecast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'resample_daily' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_it():
    for path in (ROOT / "tidecast").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidecast.llm" not in path.read_text(), path


def test_entry_without_what_the_subpackage_needs(tmp_path):
    """The forecasting queries stay where the subpackage is there but cannot be imported."""
    shutil.copytree(ROOT / "tidecast", tmp_path / "tidecast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidecast" / "llm").mkdir()
    (tmp_path / "tidecast" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tidecast" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    code = "import __spark_entry__ as e; assert 'resample_daily' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
