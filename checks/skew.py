"""A copy of the given files in which one key holds a third of the rows: ``python -m checks.skew FROM TO``.

One order has a third of the line items, one customer a third of the orders, one brand a third of the
parts (all of one question type), one nation and segment a third of the customers.
"""

from __future__ import annotations

import glob
import os
import sys

import duckdb

CHANGES = {
    "lineitem": """
SELECT * EXCLUDE (n) REPLACE (CASE WHEN n % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
                              CASE WHEN n % 3 = 0 THEN 3 ELSE l_linenumber END AS l_linenumber)
FROM (SELECT *, row_number() OVER () AS n FROM given)""",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 11 ELSE o_custkey END AS o_custkey) FROM given",
    "part": """
SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN 'Brand#3' ELSE p_brand END AS p_brand,
                  CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE p_size END AS p_size) FROM given""",
    "customer": """
SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE c_nationkey END AS c_nationkey,
                  CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment) FROM given""",
}


def skewed_copy(source: str, target: str) -> str:
    os.makedirs(target, exist_ok=True)
    con = duckdb.connect()
    for path in glob.glob(f"{source}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE OR REPLACE VIEW given AS SELECT * FROM read_parquet('{path}')")
        con.execute(f"COPY ({CHANGES.get(name, 'SELECT * FROM given')}) TO '{target}/{name}.parquet' (FORMAT parquet)")
    return target


if __name__ == "__main__":
    skewed_copy(*sys.argv[1:3])
