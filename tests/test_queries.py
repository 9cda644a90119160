import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from scriptorium.plans import catalogue

from .helpers import DATA, agree

ROOT = Path(__file__).resolve().parents[1]
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(spark, name):
    agree(spark, catalogue.QUERIES[name], catalogue.SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = """
import __spark_entry__ as e
q = e.queries()
assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)
from scriptorium import session
spark = session.build("local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
assert q["ocr_noise_flags"](spark, "/root/testdata/sf0.001").count() > 0 if __import__("os").path.exists("/root/testdata/sf0.001") else True
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
