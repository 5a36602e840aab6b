"""Every library query against its SQL on the smallest tables, and the entry module without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lodestone.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def plain(frame, columns):
    cell = lambda v: "~" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in SQL:
        assert got.count() > 0
        return
    want = duck.sql(SQL[name]).df()
    frame = got.toPandas()
    assert sorted(frame.columns) == sorted(want.columns)
    assert plain(frame, sorted(want.columns)) == plain(want, sorted(want.columns))


def test_entry_without_corpus_operators(tmp_path):
    for f in ("__spark_entry__.py", "lodestone"):
        (shutil.copytree if (ROOT / f).is_dir() else shutil.copy)(ROOT / f, tmp_path / f)
    shutil.rmtree(tmp_path / "lodestone" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql() and not any(n.startswith('op') for n in q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=100)
