"""Delimited ratings / titles readers and the mapping of ``events`` to ratings.

Text inputs are parsed with built-in expressions (``split`` + ``try_cast``, or
``from_csv`` when quoting matters), so they run inside whole-stage codegen and
accept both ``spark.read.text(path)`` frames and text derived from tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

RATING_COLS = ("user", "item", "rating", "fold")


def events_as_ratings(events: DataFrame) -> DataFrame:
    """events -> (user, item, rating, fold): user = user_id, item = props.k,
    rating = value, fold = seconds of ts mod 10 (equal to epoch mod 10)."""
    return events.select(
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("long").alias("item"),
        F.col("value").alias("rating"),
        F.pmod(F.second("ts"), F.lit(10)).alias("fold"))


def parse_ratings(lines: DataFrame, sep: str = ",", mode: str = "DROPMALFORMED",
                  value_col: str = "value") -> DataFrame:
    """Lines ``user<sep>item<sep>rating<sep>timestamp`` -> (user, item, rating, fold).

    ``sep`` may be several characters (``::``). ``mode``: ``FAILFAST`` raises on a
    bad line (the reference behaviour), ``DROPMALFORMED`` drops it,
    ``PERMISSIVE`` keeps it with NULL fields.
    """
    parts = F.split(F.trim(F.col(value_col)), re.escape(sep))
    user = F.try_element_at(parts, F.lit(1)).try_cast("long")
    item = F.try_element_at(parts, F.lit(2)).try_cast("long")
    rating = F.try_element_at(parts, F.lit(3)).try_cast("double")
    ts = F.try_element_at(parts, F.lit(4)).try_cast("long")
    out = lines.select(user.alias("user"), item.alias("item"), rating.alias("rating"),
                       F.pmod(ts, F.lit(10)).cast("int").alias("fold"),
                       (F.size(parts) == 4).alias("_ok"))
    bad = ~F.col("_ok") | F.col("user").isNull() | F.col("item").isNull() \
        | F.col("rating").isNull() | F.col("fold").isNull()
    if mode == "FAILFAST":
        out = out.withColumn("user", F.when(bad, F.raise_error(F.lit("Malformed rating line"))
                                             .cast("long")).otherwise(F.col("user")))
    elif mode == "DROPMALFORMED":
        out = out.filter(~bad)
    elif mode != "PERMISSIVE":
        raise ValueError(f"unknown mode {mode!r}")
    return out.drop("_ok")


def rating_reason(value: Column, sep: str = ",") -> Column:
    """Why a line is no rating, NULL where it is one; in the order fields, user, item, rating, timestamp."""
    parts = F.split(F.trim(value), re.escape(sep))
    bad = lambda i, kind: F.try_element_at(parts, F.lit(i)).try_cast(kind).isNull()
    return F.when(value.isNull() | (F.size(parts) != 4), "fields").when(bad(1, "long"), "user").when(bad(2, "long"), "item") \
        .when(bad(3, "double"), "rating").when(bad(4, "long"), "timestamp")


def title_reason(value: Column) -> Column:
    """Why a line is no title (id,title[,...]), NULL where it is one."""
    p = F.from_csv(value, "item STRING, title STRING, rest STRING", {"mode": "PERMISSIVE"})
    return F.when(value.isNull() | p["item"].try_cast("long").isNull(), "item").when(p["title"].isNull() | (F.trim(p["title"]) == ""), "title")


def quarantine(lines: DataFrame, reason: Column, value_col: str = "value", name: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(good lines, rejected lines with their reason), both read back from one written table.

    The input is scanned once: every line goes with its reason to a folder by that reason, below the shared
    checkpoint folder; the good ones are then read without touching the rejected.
    """
    path = shared_path(lines.sparkSession, name)
    lines.select(F.col(value_col).alias("value"), F.coalesce(reason, F.lit("ok")).alias("reason")).write.partitionBy("reason").parquet(path)
    back = lines.sparkSession.read.schema("value string, reason string").parquet(path)
    return back.where("reason = 'ok'").select("value"), back.where("reason <> 'ok'").select("value", "reason")


def read_ratings(spark: SparkSession, path: str, sep: str = ",", mode: str = "DROPMALFORMED") -> DataFrame:
    return parse_ratings(spark.read.text(path), sep=sep, mode=mode)


def parse_titles(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """CSV lines ``id,title[,...]`` -> (item, title). Quoted titles keep their
    commas (the reference split naively on every comma and cut such titles)."""
    parsed = F.from_csv(F.col(value_col), "item BIGINT, title STRING, rest STRING",
                        {"mode": "PERMISSIVE"})
    return lines.select(parsed.alias("p")).select("p.item", "p.title") \
        .filter(F.col("item").isNotNull())


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    return parse_titles(spark.read.text(path))


def positive(ratings: DataFrame, rating_col: str = "rating") -> DataFrame:
    """Keep ratings > 0 (the guarded loader's filter)."""
    return ratings.filter(F.col(rating_col) > 0)


def epoch_seconds(ts: Column) -> Column:
    """Epoch seconds of a TIMESTAMP_NTZ column read as UTC."""
    return F.unix_seconds(ts.cast("timestamp"))
