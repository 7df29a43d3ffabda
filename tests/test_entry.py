"""Every registered query against its SQL on the smallest data; the library without the training-data part."""

import math
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 5) if isinstance(value, float) else value


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    spark.catalog.clearCache()


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 10 and "score" in out.columns


def test_rest_works_without_llm(tmp_path):
    """With the subpackage and the pipeline gone, the entry still imports and names the engine's queries."""
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "quarry", ".git"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    (tmp_path / "quarry").mkdir()
    for name in os.listdir(os.path.join(ROOT, "quarry")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "quarry", name), tmp_path / "quarry" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') and n[2].isdigit() for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
