"""The entry module with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(before: str) -> list[str]:
    code = f"import sys; {before}import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10


def test_without_subpackage():
    found = names("sys.modules['folioscan.llm'] = None; sys.modules['corpus_pipeline'] = None; ")
    assert len(found) == 59 and not any(n.startswith("op") for n in found)
    assert set(found) <= set(names(""))


def test_errors_inside_are_raised(tmp_path):
    """Only the absence of the subpackage is passed over."""
    shutil.copytree(ROOT / "folioscan", tmp_path / "folioscan", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    shutil.rmtree(tmp_path / "folioscan" / "llm", ignore_errors=True)
    assert run().stdout.split() == ["59"]
    (tmp_path / "folioscan" / "llm").mkdir()
    (tmp_path / "folioscan" / "llm" / "__init__.py").write_text("")
    (tmp_path / "folioscan" / "llm" / "queries.py").write_text("import a_module_that_is_missing\n")
    assert "a_module_that_is_missing" in run().stderr


def test_nothing_else_imports_it():
    rest = [p for p in (ROOT / "folioscan").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert rest and not any("llm" in p.read_text() for p in rest)
