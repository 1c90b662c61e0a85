import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'])"


def names_in(folder):
    return subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)})


def test_queries_without_the_training_data_operators(tmp_path):
    there = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "actlake"), there / "actlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), there)
    found = names_in(there)
    assert found.returncode == 0 and found.stdout.endswith(" []\n") and int(found.stdout.split()[0]) > 70, found.stderr


def test_a_broken_operator_is_not_hidden(tmp_path):
    there = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "actlake"), there / "actlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), there)
    (there / "actlake/llm").mkdir()
    (there / "actlake/llm/queries.py").write_text("")
    (there / "corpus_pipeline.py").write_text("from actlake.llm import missing\n")
    found = names_in(there)
    assert found.returncode != 0 and "missing" in found.stderr
