"""The entry module with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"


def listed(folder):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return out.stdout


def copy(to, llm: bool, pipeline: bool):
    shutil.copytree(f"{ROOT}/seqloom", to / "seqloom", ignore=shutil.ignore_patterns("__pycache__", *([] if llm else ["llm"])))
    shutil.copy(f"{ROOT}/__spark_entry__.py", to)
    if pipeline:
        (to / "corpus_pipeline.py").write_text("from seqloom.llm.queries import QUERIES\nORACLE_SQL, run = None, QUERIES.get\n")
    return to


def test_queries_without_the_corpus_operators(tmp_path):
    from seqloom.plans.everything import QUERIES

    for name, pipeline in (("neither", False), ("pipeline", True)):
        (tmp_path / name).mkdir()
        said = listed(copy(tmp_path / name, False, pipeline))
        assert all(repr(q) in said for q in QUERIES) and "op6_" not in said and "'pipeline'" not in said


def test_a_fault_inside_is_an_error(tmp_path):
    folder = copy(tmp_path, False, True)
    (folder / "seqloom/llm").mkdir()
    (folder / "seqloom/llm/__init__.py").write_text("")
    (folder / "seqloom/llm/queries.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)})
    assert out.returncode and "no_such_module" in out.stderr
