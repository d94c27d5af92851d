"""Exact per-query k nearest neighbours by cosine distance.

Exact copies (same key and vector) collapse to one row with a multiplicity. Queries
are hashed into groups; all vectors pass by each group in slices (``search.full_top_k``),
so every vector is shipped once per group and no task holds more than a group and a
slice. Each group keeps k candidates per query; pairs are repeated for their copies
afterwards. No list of all pairs is ever made.

Rows sharing a key never pair. Distance is ``1 - u.v/(|u||v|)``; a zero vector
has no neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance
from .search import full_top_k


def usable(df: DataFrame, vec: str, dim: int | None = None) -> Column:
    """True for vectors that can be compared: present, no NULL element, of ``dim`` elements."""
    v = F.col(vec)
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    return F.coalesce(ok & (F.size(v) == dim) if dim is not None else ok, F.lit(False))


def rejected(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(key, reason) of the rows that :func:`cosine_top_k` leaves out."""
    v = F.col(vec)
    reason = F.when(v.isNull(), "no vector").when(F.size(v) != dim, "wrong length").otherwise("null element")
    return df.where(~usable(df, vec, dim)).select(key, reason.alias("reason"))


def cosine_top_k(df: DataFrame, key: str, vec: str, k: int, block_size: int | None = None, dim: int | None = None) -> DataFrame:
    """The ``k`` nearest other vectors of every vector (query, rank, ref, distance),
    ordered by (distance, ref); zero vectors have no neighbours.

    Rows without a usable vector take no part (:func:`rejected` lists them);
    ``dim`` defaults to the most frequent length. The search is exact, so its
    work grows with the square of the rows.
    """
    if dim is None:
        sizes = df.groupBy(F.size(vec).alias("n")).count().where("n >= 0").orderBy(F.desc("count"), "n").first()
        dim = sizes["n"] if sizes else 0
    df = df.where(usable(df, vec, dim))
    return full_top_k(df, key, vec, k, block_size)


def neighbor_list(df: DataFrame, key: str, vec: str, query: DataFrame) -> DataFrame:
    """All distances of one query row (a one-row frame of ``key`` and ``vec``) to the
    rows with another key: (query, ref, distance). One pass over ``df``; the
    query travels as two scalars."""
    q, v = query.select(key).scalar(), query.select(F.col(vec).cast("array<double>")).scalar()
    return df.where(usable(df, vec)).withColumn("_q", q).withColumn("_v", v).where(F.col(key) != F.col("_q")).select(
        F.col("_q").alias("query"), F.col(key).alias("ref"), cosine_distance("_v", vec).alias("distance"))
