"""Readers for the small text dictionaries of the scoring job: the image URL
index, the class-id -> uid label map (protobuf text) and uid -> name lines.

All take a DataFrame with a text column ``value`` (``spark.read.text`` for line
files, ``spark.read.text(path, wholetext=True)`` for the label map), so many
files are parsed in parallel and nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir


def parse_url_index(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """``img_id img_url`` lines split on whitespace; lines without exactly two
    tokens are skipped."""
    toks = F.split(F.trim(F.col(value_col)), r"\s+")
    return lines.select(toks.alias("t")).filter(F.size("t") == 2) \
        .select(F.element_at("t", 1).alias("img_id"), F.element_at("t", 2).alias("img_url"))


def read_url_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_url_index(spark.read.text(path))


_CLASS, _STRING = r"^  target_class: (\d+)", r'^  target_class_string: "(.*)"'


def parse_label_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Numbered lines (file, line, ``value_col``) of label maps -> (node, uid).

    A string belongs to the class line before it, unless a string stands between: a class
    without a string has no row, and does not shift those that follow. No file is
    gathered: class and string lines are range-partitioned by file and line, each looks at
    the one before it, and the first of a file in a partition at the last line of the partition before, from a
    table with one row per file and partition.
    """
    ensure_checkpoint_dir(lines.sparkSession)
    v = F.col(value_col)
    rows = lines.select("file", "line", F.nullif(F.regexp_extract(v, _CLASS, 1), F.lit("")).cast("int").alias("node"),
                        F.when(v.rlike(_STRING), F.regexp_extract(v, _STRING, 1)).alias("uid"))
    rows = rows.where("node IS NOT NULL OR uid IS NOT NULL").repartitionByRange("file", "line")
    rows = rows.withColumn("part", F.spark_partition_id()).checkpoint()
    here = Window.partitionBy("part", "file").orderBy("line")
    named = rows.withColumn("before", F.lag("node").over(here)).withColumn("first", F.row_number().over(here) == 1)
    ends = rows.groupBy("part", "file").agg(F.max_by("node", "line").alias("last"))
    carried = ends.select("part", "file", F.lag("last").over(Window.partitionBy("file").orderBy("part")).alias("carried"))
    out = named.where("uid IS NOT NULL").join(carried, ["part", "file"])
    return out.select(F.when(F.col("first"), F.col("carried")).otherwise(F.col("before")).alias("node"), "uid").where("node IS NOT NULL")


def parse_label_map(texts: DataFrame, value_col: str = "value") -> DataFrame:
    """Whole-file texts with ``  target_class: N`` followed by
    ``  target_class_string: "uid"`` -> (node, uid), quotes removed.

    Each text is cut into lines, which :func:`parse_label_lines` reads.
    """
    lines = texts.select(F.monotonically_increasing_id().alias("file"), F.split(F.col(value_col), r"\R").alias("v"))
    return parse_label_lines(lines.select("file", F.posexplode("v").alias("line", "value")))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """Label maps of any size: the files are read line by line, in splits.

    A line's place is the start of its split and, inside it, a number that counts up.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return parse_label_lines(lines.withColumn("line", F.struct("start", "id")))


def parse_uid_names(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """``uid<TAB>name`` lines -> (uid, name)."""
    parts = F.split(F.col(value_col), "\t", 2)
    return lines.select(parts.alias("p")).filter(F.size("p") == 2) \
        .select(F.element_at("p", 1).alias("uid"), F.element_at("p", 2).alias("name"))


def read_uid_names(spark: SparkSession, path: str) -> DataFrame:
    return parse_uid_names(spark.read.text(path))


def compose_lookup(node_uid: DataFrame, uid_name: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node -> uid -> name. Returns (resolved (node, uid, name), unmatched (node, uid))."""
    resolved = node_uid.join(uid_name, "uid", "inner").select("node", "uid", "name")
    unmatched = node_uid.join(uid_name, "uid", "left_anti").select("node", "uid")
    return resolved, unmatched
