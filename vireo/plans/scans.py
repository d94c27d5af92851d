"""Scan, projection, filter and limit plans (the catalogue/evaluation reads of
the reference, which pushed a projected, filtered, limited subquery into the
database; here the same projection and predicate reach the parquet scan)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..sources import scan

LIMIT = 800


def q_scan_project_filter(spark, sf_dir):
    return scan(spark, "parquet", os.path.join(sf_dir, "customer.parquet"),
                columns=["c_custkey", "c_name", "c_mktsegment"],
                predicate=F.col("c_mktsegment") == "BUILDING")


def q_filter_not_equal(spark, sf_dir):
    return scan(spark, "parquet", os.path.join(sf_dir, "lineitem.parquet"),
                columns=["l_orderkey", "l_linenumber", "l_quantity"],
                predicate=F.col("l_linenumber") != 1)


def q_scan_limit(spark, sf_dir):
    return scan(spark, "parquet", os.path.join(sf_dir, "lineitem.parquet"),
                columns=["l_orderkey", "l_linenumber", "l_partkey"], limit=LIMIT,
                order_by=["l_orderkey", "l_linenumber", "l_partkey"])  # total order: (key, line) repeats


ORACLE = {
    "scan_project_filter": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_not_equal": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <> 1",
    "scan_limit": f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT {LIMIT}""",
}

QUERIES = {
    "scan_project_filter": q_scan_project_filter,
    "filter_not_equal": q_filter_not_equal,
    "scan_limit": q_scan_limit,
}
