import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(sum(k.startswith('op') for k in q), len(q), 'pipeline' in q)"


def names(at):
    return subprocess.run([sys.executable, "-B", "-c", CODE], cwd=at, capture_output=True, text=True, check=True).stdout.split()


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["source", "sections", "tokens"] and rows.count() > 0


def test_the_rest_stands_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for gone in ("folioforge/llm", "tests/llm"):
        shutil.rmtree(copy / gone)
    n_op, n, pipeline = names(copy)
    assert (n_op, pipeline) == ("0", "False") and int(n) > 100
    (copy / "corpus_pipeline.py").unlink()
    assert names(copy) == [n_op, n, pipeline]
    run = [sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests"]
    assert subprocess.run([*run, "--collect-only"], cwd=copy, capture_output=True).returncode == 0
    assert subprocess.run([*run, "-k", "tokens or criticality or d4_number"], cwd=copy, capture_output=True).returncode == 0


def test_scratch_tables_need_a_shared_folder(spark, monkeypatch):
    from folioforge import session

    unset = type("Conf", (), {"get": lambda self, name, default=None: default})()
    context = lambda master: type("Context", (), {"master": master, "applicationId": f"app-{master}"})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(type("Session", (), {"conf": unset, "sparkContext": context("spark://host:7077")})())
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
