"""The detector-evaluation queries read every line."""

from __future__ import annotations

from pathlib import Path

import duckdb

from sparkyard.plans import evaluate_queries as eq


def test_every_line_is_a_box(spark, data):
    n, top = duckdb.execute(f"SELECT count(*), max(l_linenumber) FROM read_parquet('{Path(data, 'sf0.001', 'lineitem.parquet')}')").fetchone()
    assert eq.truth(spark, f"{data}/sf0.001").count() == n and top > 3
    assert all("l_linenumber <=" not in q for q in eq.oracle_sql().values())
