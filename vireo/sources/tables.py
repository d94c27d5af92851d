"""Generic scan: parquet / csv / json / jdbc with projection, predicate and limit.

Everything stays lazy and distributed: the predicate and the column list reach
the file scan (``PushedFilters`` / ``ReadSchema`` in the plan) and, for JDBC,
the database.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def scan(spark: SparkSession, fmt: str, path: str | None = None, columns=None,
         predicate: Column | str | None = None, limit: int | None = None,
         order_by=None, schema=None, **options) -> DataFrame:
    """Scan a source with pushed-down projection and predicate.

    ``fmt`` is any DataFrameReader format (parquet, csv, json, text, jdbc, ...).
    For JDBC pass ``url``/``dbtable`` (or ``query``) and, for a parallel read,
    ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``.
    ``limit`` keeps the first rows by ``order_by`` (a deterministic top-N, not an
    arbitrary sample); without ``order_by`` it keeps any ``limit`` rows.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if options:
        reader = reader.options(**{k: str(v) for k, v in options.items()})
    df = reader.load(path) if path is not None else reader.load()
    if predicate is not None:
        df = df.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)
    if columns:
        df = df.select(*columns)
    if limit is not None:
        if order_by:
            df = df.orderBy(*order_by)
        df = df.limit(limit)
    return df


def jdbc_scan(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, fetch_size: int = 10_000, columns=None,
              predicate: Column | str | None = None, **options) -> DataFrame:
    """Parallel JDBC read: ``num_partitions`` range slices of ``partition_column``
    read by as many tasks (the reference read one unpartitioned result and
    collected it on the driver). Column list and predicate are applied to the
    DataFrame, so Spark pushes them into each slice's SQL."""
    opts = {"url": url, "fetchsize": str(fetch_size), **{k: str(v) for k, v in options.items()}}
    if query is not None:
        if partition_column:
            table, query = f"({query}) vireo_q", None
        else:
            opts["query"] = query
    if table is not None:
        opts["dbtable"] = table
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    return scan(spark, "jdbc", None, columns=columns, predicate=predicate, **opts)


def require_non_empty(df: DataFrame, what: str = "input") -> DataFrame:
    """Fail fast when ``df`` has no rows (one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError(f"No rows in {what}.")
    return df
