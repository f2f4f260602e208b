"""Registered queries against DuckDB at sf0.01, where SQL can express them."""

from __future__ import annotations

import duckdb
import pytest

from compare import compare
from conftest import SF001
from orderscope.llm.oracle import ORACLE_SQL
from orderscope.llm.queries import QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF001}/{table}.parquet')")
    problems = compare(QUERIES[name](spark, SF001), con, ORACLE_SQL[name])
    assert not problems, problems


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
