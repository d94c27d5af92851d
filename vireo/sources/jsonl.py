"""JSON-lines sink and source (compact JSON, one object per line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", keep_nulls: bool = False) -> None:
    """One part file per partition, compact separators (as ``json.dumps`` with
    ``(',', ':')``). Null fields are dropped unless ``keep_nulls``."""
    df.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def to_json_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Rows -> one compact JSON text column."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(col))


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Declared schema, no inference pass over the data."""
    return spark.read.schema(schema).json(path)


def parse_json_lines(lines: DataFrame, schema, col: str = "value") -> DataFrame:
    return lines.select(F.from_json(F.col(col), schema).alias("r")).select("r.*")
