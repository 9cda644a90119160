"""Comparison of a Spark query with its SQL in DuckDB."""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else v.tolist() if hasattr(v, "tolist") else v


def rows_of(table):
    names = sorted(table.column_names)
    return names, Counter(tuple(str(cell(v)) for v in r) for r in zip(*[table.column(c).to_pylist() for c in names]))


def agree(spark, query, sql: str, folder: Path = DATA) -> None:
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    names, own = rows_of(query(spark, str(folder)).toArrow())
    expected_names, expected = rows_of(con.sql(sql).to_arrow_table())
    assert names == expected_names
    assert own == expected
