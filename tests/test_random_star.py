"""Differential test on generated star schemas with the cases the driver
data lacks: NULL keys, names, prices and dates, orphan facts, duplicate
dimension keys, colliding names and many ties. Every registered query must
equal its DuckDB SQL on the same files."""

from __future__ import annotations

import datetime as dt
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_module
from orderscope.plans.registry import QUERIES as NAMES
from compare import compare, duck


def _nullify(rng, values, share=0.06):
    return [None if rng.random() < share else v for v in values]


def _write(folder: str, seed: int) -> None:
    rng = np.random.default_rng(seed)
    n_region, n_nation, n_cust, n_supp, n_part, n_orders, n_lines = 3, 6, 40, 8, 30, 300, 900
    day0 = dt.datetime(2020, 1, 1)

    def ints(lo, hi, n):
        return [int(x) for x in rng.integers(lo, hi, n)]

    def money(n, hi=2000_00):
        return [int(x) / 100 for x in rng.integers(0, hi, n)]

    tables = {
        "region": {"r_regionkey": pa.array(range(n_region), pa.int32()),
                   "r_name": pa.array(["EAST", "WEST", "EAST"][:n_region])},
        "nation": {"n_nationkey": pa.array(range(n_nation), pa.int32()),
                   "n_name": pa.array(_nullify(rng, [f"N{i % 4}" for i in range(n_nation)], 0.15)),
                   "n_regionkey": pa.array(ints(0, n_region + 1, n_nation), pa.int32())},
        "customer": {"c_custkey": pa.array(_nullify(rng, list(range(n_cust - 2)) + [3, 5]), pa.int64()),
                     "c_name": pa.array(_nullify(rng, [f"C{i % 25}" for i in range(n_cust)])),
                     "c_nationkey": pa.array(ints(0, n_nation + 1, n_cust), pa.int32()),
                     "c_mktsegment": pa.array(_nullify(rng, [["A", "B", "C", "D"][i % 4] for i in range(n_cust)]))},
        "supplier": {"s_suppkey": pa.array(range(n_supp), pa.int64()),
                     "s_name": pa.array([f"S{i % 5}" for i in range(n_supp)]),
                     "s_nationkey": pa.array(ints(0, n_nation, n_supp), pa.int32())},
        "part": {"p_partkey": pa.array(range(n_part), pa.int64()),
                 "p_name": pa.array(_nullify(rng, [f"P{i % 9}" for i in range(n_part)])),
                 "p_type": pa.array([f"T{i % 4}" for i in range(n_part)]),
                 "p_brand": pa.array([f"B{i % 3}" for i in range(n_part)])},
        "orders": {"o_orderkey": pa.array(range(n_orders), pa.int64()),
                   "o_custkey": pa.array(_nullify(rng, ints(0, n_cust + 3, n_orders)), pa.int64()),
                   "o_orderstatus": pa.array(_nullify(rng, [["F", "O", "P"][x] for x in ints(0, 3, n_orders)])),
                   "o_totalprice": pa.array(_nullify(rng, money(n_orders, 50_00)), pa.float64()),
                   "o_orderdate": pa.array(_nullify(rng, [day0 + dt.timedelta(days=d) for d in ints(0, 500, n_orders)]),
                                           pa.timestamp("us")),
                   "o_orderpriority": pa.array([f"{x}-P" for x in ints(1, 4, n_orders)])},
        "lineitem": {"l_orderkey": pa.array(ints(0, n_orders + 20, n_lines), pa.int64()),
                     "l_partkey": pa.array(_nullify(rng, ints(0, n_part + 2, n_lines)), pa.int64()),
                     "l_suppkey": pa.array(ints(0, n_supp + 1, n_lines), pa.int64()),
                     "l_quantity": pa.array(_nullify(rng, [float(x) for x in ints(1, 6, n_lines)]), pa.float64()),
                     "l_extendedprice": pa.array(_nullify(rng, money(n_lines, 300_00)), pa.float64()),
                     "l_discount": pa.array([x / 100 for x in ints(0, 11, n_lines)], pa.float64()),
                     "l_returnflag": pa.array([["A", "N", "R"][x] for x in ints(0, 3, n_lines)]),
                     "l_shipdate": pa.array(_nullify(rng, [day0 + dt.timedelta(days=d) for d in ints(0, 600, n_lines)]),
                                            pa.timestamp("us"))},
    }
    for name, cols in tables.items():
        pq.write_table(pa.table(cols), f"{folder}/{name}.parquet")


@pytest.fixture(scope="module", params=[11, 29])
def generated(request):
    folder = tempfile.mkdtemp(prefix=f"orderscope-star-{request.param}-")
    _write(folder, request.param)
    return folder, duck(folder)


def test_all_queries_match_on_generated_star(spark, generated):
    folder, con = generated
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    failures = {}
    for name in NAMES:
        problems = compare(queries[name](spark, folder), con, oracle[name])
        if problems:
            failures[name] = problems
    assert not failures, failures
