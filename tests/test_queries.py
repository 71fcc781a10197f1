"""The registered queries against their DuckDB SQL, and the entry module without the optional subpackage."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = sorted(n for n in entry.oracle_sql() if n in entry.queries())


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{round(value, 6) + 0.0:.6f}"
    return str(value)


def normal(frame):
    frame = frame.astype({c: "float64" for c, t in frame.dtypes.items() if str(t) in ("Int32", "Int64")})  # whole numbers with nulls, as Spark hands them over
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert normal(entry.queries()[name](spark, sf_dir).toPandas()) == normal(duck.sql(entry.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["qid", "doc_id", "score", "rank"] and rows.limit(1).count() == 1


def test_entry_module_stands_without_the_subpackage(tmp_path):
    root = Path(entry.__file__).parent
    for part in ("lexloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(root / part), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "lexloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})
