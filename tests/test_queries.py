"""Every registered query of the core against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from stratadoc.plans import catalogue, library  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.6f}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.6f}"
    return str(value)


def flat(rows, columns):
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    out = catalogue.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    rows = flat([r.asDict() for r in out.collect()], columns)
    if name not in catalogue.ORACLES:
        assert rows or name == "native"
        return
    want = sql.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows == flat([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


def test_the_entry_imports_without_the_training_data_operators(tmp_path):
    """The core, its queries and the driver's entry don't need the subpackage or the pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/stratadoc", tmp_path / "stratadoc", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
