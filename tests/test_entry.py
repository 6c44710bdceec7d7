import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)


def test_optional_subpackage(tmp_path):
    """Absent, the other queries work; broken, the import fails rather than losing queries silently."""
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found = names(tmp_path)
    assert found.returncode == 0 and "merge_on_read" in found.stdout and "op1" not in found.stdout and "pipeline" not in found.stdout
    broken = tmp_path / "tessera" / "llm"
    broken.mkdir()
    (broken / "__init__.py").touch()
    (broken / "queries.py").write_text("import a_module_that_is_missing\n")
    assert "a_module_that_is_missing" in names(tmp_path).stderr
