import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["workspace_id", "term", "mentions", "degree"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_stands_alone(tmp_path):
    """Without the training-data package the entry module still loads."""
    import shutil

    shutil.copytree(ROOT / "kgspark", tmp_path / "kgspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__", "test_entry.py"))
    done = subprocess.run([sys.executable, "-m", "pytest", "tests/test_text.py", "-q", "-x"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]


def test_an_error_within_the_package_is_not_hidden(tmp_path):
    import shutil

    shutil.copytree(ROOT / "kgspark", tmp_path / "kgspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "kgspark" / "llm").mkdir()
    (tmp_path / "kgspark" / "llm" / "__init__.py").write_text("")
    (tmp_path / "kgspark" / "llm" / "oracles.py").write_text("import no_such_module")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True).returncode != 0


def test_nothing_uses_local_checkpoints():
    for f in (ROOT / "kgspark").rglob("*.py"):
        assert "localCheckpoint(" not in f.read_text()
