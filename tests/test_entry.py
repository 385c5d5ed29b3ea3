"""The entry point with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


def _copy(base, *left_out):
    shutil.copytree(os.path.join(ROOT, "evalspark"), os.path.join(base, "evalspark"),
                    ignore=lambda d, names: [n for n in names if n in left_out or n == "__pycache__"])
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if f not in left_out:
            shutil.copy(os.path.join(ROOT, f), base)


def _listed(base):
    env = {**os.environ, "PYTHONPATH": ""}
    p = subprocess.run([sys.executable, "-c", LIST], cwd=base, env=env, capture_output=True, text=True)
    assert p.returncode == 0, p.stderr
    return [eval(line) for line in p.stdout.splitlines()]


def test_without_the_llm_folder(tmp_path):
    from evalspark.plans.registry import all_queries
    _copy(tmp_path, "llm")  # corpus_pipeline.py is still there
    names, sql = _listed(tmp_path)
    assert names == sorted(all_queries())
    assert sql == sorted(n for n, q in all_queries().items() if q.sql)


def test_without_the_llm_folder_and_the_pipeline(tmp_path):
    from evalspark.plans.registry import all_queries
    _copy(tmp_path, "llm", "corpus_pipeline.py")
    assert _listed(tmp_path)[0] == sorted(all_queries())


def test_without_the_pipeline_only(tmp_path):
    _copy(tmp_path, "corpus_pipeline.py")
    names, _ = _listed(tmp_path)
    if os.path.isdir(os.path.join(ROOT, "evalspark", "llm")):
        assert any(n.startswith("op1_") for n in names)
    assert "pipeline" not in names
