"""Every query with SQL against DuckDB on the smallest tables; the others for their rows' schema."""

from __future__ import annotations

import ast
from pathlib import Path

import duckdb
import pytest

from compare import norm
from sparkyard.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data, "sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, f"{data}/sf0.001")
    cols = sorted(df.columns)
    got = sorted(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
    if name in SQL:
        r = duck.execute(SQL[name])
        have = [x[0] for x in r.description]
        assert sorted(have) == cols
        assert got == sorted(tuple(norm(x[have.index(c)]) for c in cols) for x in r.fetchall())


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_nothing_imports_llm():
    for p in [*ROOT.glob("*.py"), *ROOT.glob("sparkyard/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" in p.relative_to(ROOT).parts or p.name == "__spark_entry__.py":
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any(x.startswith("sparkyard.llm") for x in names), p
