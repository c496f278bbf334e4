import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') for n in q), 'pipeline' in q)"


def show(folder):
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_entry_with_and_without_the_operators(tmp_path):
    whole = (ROOT / "corpus_pipeline.py").exists() and (ROOT / "tesserae/llm").is_dir()
    assert show(ROOT)[2:] == [str(whole)] * 2
    for item in ("__spark_entry__.py", "tesserae"):
        src = ROOT / item
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / item)
    shutil.rmtree(tmp_path / "tesserae/llm", ignore_errors=True)
    n, sql, ops, pipeline = show(tmp_path)
    assert int(n) > 50 and int(sql) > 45 and (ops, pipeline) == ("False", "False")


def test_the_library_imports_no_operator():
    for f in (ROOT / "tesserae").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text().split()


def test_entry_runs(spark):
    import __spark_entry__

    if Path("/root/testdata/sf0.001").is_dir():
        assert __spark_entry__.entry(spark).count() > 0
