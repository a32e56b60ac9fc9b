import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """A copy without the folders of that part, and one that still has the pipeline file: all other queries are there."""
    for drop_pipeline in (True, False):
        copy = tmp_path / f"copy{drop_pipeline}"
        copy.mkdir()
        shutil.copytree(os.path.join(ROOT, "lociforge"), copy / "lociforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if os.path.exists(os.path.join(ROOT, name)) and not (drop_pipeline and name.startswith("corpus")):
                shutil.copy(os.path.join(ROOT, name), copy / name)
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in q))"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) == int(out[1]) > 80 and out[2] == "0"
