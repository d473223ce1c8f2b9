import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from gridloom.plans.oracles import ORACLES

SMALL = "/root/testdata/sf0.001"
ROOT = Path(e.__file__).resolve().parent


def test_contract(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).schema) == 4


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_grid_queries_outlive_the_corpus_operators(tmp_path, pipeline):
    """The folders of the corpus operators can go, with or without the pipeline's file."""
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    # A folder that holds nothing but old byte code is no package either.
    (tree / "gridloom/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tree, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tree)})
    assert out.returncode == 0, out.stderr
    names, sql = (set(x.split()) for x in out.stdout.strip().split("\n")[-2:])
    from gridloom.plans import queries

    assert names == set(queries.queries()) and sql == set(ORACLES)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for x in os.listdir(SMALL):
        con.execute(f"create view {x[:-8]} as select * from '{SMALL}/{x}'")
    return con


def ordered(frame, cols):
    """Rows in an order that the last decimals, where sums may differ, have no say in."""
    key = lambda x: str(round(float(x), 3) + 0.0) if isinstance(x, (int, float)) and x is not None else str(x)
    return sorted(frame[cols].astype(object).itertuples(index=False, name=None), key=lambda r: tuple(map(key, r)))


def same(x, y):
    if isinstance(x, (int, float)) and isinstance(y, (int, float)):
        return x == pytest.approx(y, abs=2.1e-5, nan_ok=True)
    return str(x) == str(y)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, tables, name):
    want = tables.execute(ORACLES[name]).df()
    got = e.queries()[name](spark, SMALL).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(ordered(got, cols), ordered(want, cols), strict=True) for x, y in zip(a, b, strict=True))
