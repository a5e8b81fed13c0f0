from __future__ import annotations

import os

import duckdb
import pytest

from normloom.llm import queries


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in sorted(os.listdir(small)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, tables, name):
    df = queries.queries()[name](spark, small)
    found = tables.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize(("name", "columns"), [("p4_found", ["judge_id", "defect"]), ("p5_found", ["chunk_idx", "line_no"]), ("p6_found", ["chunk_idx_a", "chunk_idx_b"]), ("p8_found", ["doc_id", "item_id"]), ("p10_found", ["doc_id"])])
def test_found_columns_and_no_repeated_rows(spark, small, name, columns):
    df = queries.queries()[name](spark, small)
    assert df.columns == columns
    rows = df.collect()
    assert len(rows) == len(set(rows))
