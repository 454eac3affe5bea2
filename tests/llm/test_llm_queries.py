"""Queries with SQL against DuckDB on the smallest tables, the others for that they run."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from compare import norm
from sparkyard.llm import queries as q

QUERIES, SQL = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, f"{data}/sf0.001")
    cols = sorted(df.columns)
    got = sorted(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
    if name.endswith("_found"):
        assert len(set(got)) == len(got)
    if name in SQL:
        con = duckdb.connect()
        for p in Path(data, "sf0.001").glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        r = con.execute(SQL[name])
        have = [x[0] for x in r.description]
        assert sorted(have) == cols
        assert got == sorted(tuple(norm(x[have.index(c)]) for c in cols) for x in r.fetchall())


def test_found_columns(spark, data):
    want = {
        "p1_found": [("image", "string"), ("group_id", "string")], "p2_found": [("image_id_a", "bigint"), ("image_id_b", "bigint")], "p5_found": [("audit_id", "bigint"), ("class_id", "int")],
        "p6_found": [("source", "string"), ("group_id", "string")], "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p9_found": [("doc_id", "bigint")],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, f"{data}/sf0.001").dtypes == columns, name
