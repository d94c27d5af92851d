"""Ranking-quality metrics over ranked lists in long form.

A ranked list is a set of rows (query, order keys..., rel). :func:`rank_lists`
numbers the rows of each query (skew-safe, see ``ordered_prefix``; a metric at a cut-off
needs its first k rows only) and adds the
binarised relevance and its running count; every metric below is then a grouped
aggregate with map-side partial aggregation, so no query's list is ever
gathered in one place.

Definitions (rel_1..rel_n in rank order, m = min(k, n), bin_i = relevant flag):

* MRR: mean over queries of 1/(rank of first relevant), 0 if none.
* R-precision: (#relevant) / (rank of the last relevant), 0 if none.
* P@k: mean bin over the first k; undefined (NULL, or an error if strict) if n < k.
* AP prefix (as executed by the reference job): (1/m) * sum_{i<=m} P@i.
* AP classic (as documented): (1/#rel) * sum_i bin_i * P@i, 0 if none.
* DCG@k method 0: rel_1 + sum_{i=2..m} rel_i / log2(i); method 1: sum rel_i / log2(i+1).
* nDCG@k: DCG@k / IDCG@k, IDCG from the whole list sorted by rel descending
  and cut at k; 0 when IDCG is 0. Linear gain (not 2^rel - 1).

The ideal order is numeric (the reference sorted score *strings*, equal for
one-digit scores). Single-row queries are kept.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import first_in_group, ordered_prefix, top_k_per_group


def binarize(rel: Column | str, threshold: float = 2.0) -> Column:
    """Relevant when ``rel >= threshold`` (the evaluation job uses 2)."""
    c = F.col(rel) if isinstance(rel, str) else rel
    return (c >= F.lit(threshold)).cast("double")


def nonzero(rel: Column | str) -> Column:
    c = F.col(rel) if isinstance(rel, str) else rel
    return (c != F.lit(0)).cast("double")


def discount(pos: Column, method: int = 0) -> Column:
    """Positional weight: method 0 -> 1, 1, 1/log2(3), ...; method 1 -> 1/log2(i+1)."""
    if method == 0:
        return F.lit(1.0) / F.greatest(F.lit(1.0), F.log2(pos))
    if method == 1:
        return F.lit(1.0) / F.log2(pos + F.lit(1))
    raise ValueError("unknown discount method: 0 and 1 are known")


def rank_lists(df: DataFrame, query: str, order_cols: Sequence, rel: Column | str,
               relevant: Column | None = None, k: int | None = None) -> DataFrame:
    """(query, order..., rel) rows -> (query, pos, rel, bin, cum_bin).

    ``relevant`` is the binarisation (default: rel != 0); ``order_cols`` must be a
    total order within a query. With ``k`` only the first k rows of each query,
    which is all that the metrics at a cut-off need; the rest is pruned before
    the shuffle.
    """
    relc = (F.col(rel) if isinstance(rel, str) else rel).cast("double")
    base = df.select(F.col(query), *[F.col(c) if isinstance(c, str) else c for c in order_cols],
                     relc.alias("rel"))
    bin_expr = relevant if relevant is not None else nonzero(F.col("rel"))
    base = base.withColumn("bin", bin_expr.cast("double"))
    order_names = [c for c in base.columns if c not in (query, "rel", "bin")]
    sums = {"cum_bin": F.col("bin")}
    out = first_in_group(base, [query], order_names, k, sums) if k else ordered_prefix(base, [query], order_names, sums)
    return out.select(query, "pos", "rel", "bin", "cum_bin")


def explode_lists(df: DataFrame, query: str, scores: str, sep: str = " ") -> DataFrame:
    """(query, list) rows -> long form (query, o, rel) ready for :func:`rank_lists`
    with ``order_cols=["o"]``. ``scores`` is an array of numbers in rank order or
    a ``sep``-joined string of them (the evaluation job's concatenated scores).
    One ``posexplode`` per row: no shuffle."""
    col = F.col(scores)
    if isinstance(df.schema[scores].dataType, T.StringType):
        col = F.split(F.trim(col), re.escape(sep))
    return df.select(F.col(query), F.posexplode(col).alias("o", "rel")) \
        .select(query, (F.col("o") + 1).alias("o"), F.col("rel").cast("double").alias("rel"))


def relevant_rank(df: DataFrame, query: str, order_cols: Sequence, relevant: Column, last: bool = False) -> DataFrame:
    """(query, pos, hits): rank of the first (or ``last``) relevant row of each
    list, NULL without one, and the number of relevant rows.

    The rank is the number of rows up to that row's key, so nothing is numbered
    or sorted: two aggregates with partials and one equi-join."""
    key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_cols])
    rows = df.select(F.struct(query).alias("q"), key.alias("key"), relevant.cast("double").alias("bin"))
    at = (F.max if last else F.min)(F.when(F.col("bin") > 0, F.col("key")))
    edge = rows.groupBy("q").agg(at.alias("edge"), F.sum("bin").alias("hits"))
    upto = F.count(F.when(F.col("key") <= F.col("edge"), 1))
    out = rows.select("q", "key").join(edge, "q").groupBy("q", "hits").agg(upto.alias("pos"))
    return out.select(F.col("q")[query].alias(query), F.when(F.col("pos") > 0, F.col("pos")).alias("pos"), "hits")


def reciprocal_rank(ranked: DataFrame, query: str) -> DataFrame:
    first = F.min(F.when(F.col("bin") > 0, F.col("pos")))
    return ranked.groupBy(query).agg(F.coalesce(F.lit(1.0) / first, F.lit(0.0)).alias("rr"))


def mean_reciprocal_rank(ranked: DataFrame, query: str) -> DataFrame:
    return reciprocal_rank(ranked, query).agg(F.avg("rr").alias("mrr"))


def r_precision(ranked: DataFrame, query: str) -> DataFrame:
    last = F.max(F.when(F.col("bin") > 0, F.col("pos")))
    return ranked.groupBy(query).agg(
        F.coalesce(F.sum("bin") / last, F.lit(0.0)).alias("r_precision"))


def precision_at_k(ranked: DataFrame, query: str, k: int, strict: bool = False) -> DataFrame:
    """P@k per query; NULL when the list is shorter than k (error when ``strict``)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    n = F.count(F.lit(1))
    hits = F.sum(F.when(F.col("pos") <= k, F.col("bin")).otherwise(F.lit(0.0)))
    short = n < F.lit(k)
    val = F.when(short, F.raise_error(F.lit("list has fewer than k rows")) if strict else F.lit(None)) \
        .otherwise(hits / F.lit(float(k)))
    return ranked.groupBy(query).agg(val.cast("double").alias("precision_at_k"))


def prefix_precision(ranked: DataFrame) -> DataFrame:
    """Running precision P@pos for every row of every list."""
    return ranked.withColumn("precision", F.col("cum_bin") / F.col("pos"))


def average_precision_prefix(ranked: DataFrame, query: str, k: int) -> DataFrame:
    """AP as the reference job executes it: mean of P@1..P@m, m = min(k, n)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    top = ranked.filter(F.col("pos") <= k)
    return top.groupBy(query).agg(
        F.avg(F.col("cum_bin") / F.col("pos")).alias("ap"))


def average_precision(ranked: DataFrame, query: str) -> DataFrame:
    """Classic AP: mean of P@i over the relevant positions, 0 if none."""
    num = F.sum(F.when(F.col("bin") > 0, F.col("cum_bin") / F.col("pos")))
    return ranked.groupBy(query).agg(
        F.coalesce(num / F.sum("bin"), F.lit(0.0)).alias("ap"))


def mean_average_precision(ranked: DataFrame, query: str) -> DataFrame:
    return average_precision(ranked, query).agg(F.avg("ap").alias("map"))


def dcg_at_k(ranked: DataFrame, query: str, k: int, method: int = 0) -> DataFrame:
    top = ranked.filter(F.col("pos") <= k)
    return top.groupBy(query).agg(
        F.sum(F.col("rel") * discount(F.col("pos"), method)).alias("dcg"))


def ideal_dcg_at_k(df: DataFrame, query: str, rel: str, tie_cols: Sequence, k: int,
                   method: int = 0) -> DataFrame:
    """IDCG@k: top-k of each query by rel descending (partial top-k per task)."""
    top = top_k_per_group(df, [query], [F.col(rel).desc(), *tie_cols], k, rank_col="ipos")
    return top.groupBy(query).agg(
        F.sum(F.col(rel) * discount(F.col("ipos"), method)).alias("idcg"))


def ndcg_at_k(ranked: DataFrame, query: str, k: int = 5, method: int = 0,
              source: DataFrame | None = None) -> DataFrame:
    """nDCG@k per query over a :func:`rank_lists` frame.

    ``source`` (query, rel) rows, e.g. the input of ``rank_lists``, lets the
    ideal order be computed straight from the scan instead of a second pass
    over the numbered frame (IDCG does not depend on the order of ties).
    """
    dcg = dcg_at_k(ranked, query, k, method)
    ideal_src = source.select(query, F.col("rel").cast("double").alias("rel")) if source is not None \
        else ranked.select(query, "rel")
    idcg = ideal_dcg_at_k(ideal_src, query, "rel", [], k, method)
    return dcg.join(idcg, query).select(
        query,
        F.when(F.col("idcg") == 0, F.lit(0.0)).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def _k_contrib(df: DataFrame, pos: str, max_k: int) -> DataFrame:
    """One row per (row, k) for every cut-off k >= pos (rows past max_k dropped)."""
    return df.filter(F.col(pos) <= max_k) \
        .withColumn("k", F.explode(F.sequence(F.col(pos).cast("int"), F.lit(max_k))))


def per_query_sweep(ranked: DataFrame, query: str, ks: Sequence[int] = (1, 2, 3, 4, 5),
                    method: int = 0, source: DataFrame | None = None) -> DataFrame:
    """nDCG@k and AP-prefix@k for every query and every k in ``ks`` in one grouped pass.

    Actual-order and ideal-order contributions are unioned and summed by
    (query, k), so there is a single aggregation shuffle and no join.
    """
    max_k = max(ks)
    actual = _k_contrib(ranked, "pos", max_k).select(
        query, "k",
        (F.col("rel") * discount(F.col("pos"), method)).alias("dcg_c"),
        (F.col("cum_bin") / F.col("pos")).alias("ap_c"),
        F.lit(0.0).alias("idcg_c"),
        F.lit(1).alias("m_c"))
    ideal_src = source.select(query, F.col("rel").cast("double").alias("rel")) if source is not None \
        else ranked.select(query, "rel")
    ideal_top = top_k_per_group(ideal_src, [query], [F.col("rel").desc()], max_k, rank_col="ipos")
    ideal = _k_contrib(ideal_top, "ipos", max_k).select(
        query, "k",
        F.lit(0.0).alias("dcg_c"), F.lit(0.0).alias("ap_c"),
        (F.col("rel") * discount(F.col("ipos"), method)).alias("idcg_c"),
        F.lit(0).alias("m_c"))
    g = actual.unionByName(ideal).groupBy(query, "k").agg(
        F.sum("dcg_c").alias("dcg"), F.sum("idcg_c").alias("idcg"),
        F.sum("ap_c").alias("ap_sum"), F.sum("m_c").alias("m"))
    g = g.filter(F.col("k").isin(list(ks)))
    return g.select(
        query, F.col("k").cast("int").alias("k"),
        F.when(F.col("idcg") == 0, F.lit(0.0)).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        F.try_divide(F.col("ap_sum"), F.col("m")).alias("ap"))


def eval_sweep(ranked: DataFrame, query: str, ks: Sequence[int] = (1, 2, 3, 4, 5),
               method: int = 0, source: DataFrame | None = None) -> DataFrame:
    """Mean nDCG@k and mean AP@k over queries: rows (metric, k, score), nDCG first."""
    pq = per_query_sweep(ranked, query, ks, method, source)
    means = pq.groupBy("k").agg(F.avg("ndcg").alias("ndcg"), F.avg("ap").alias("map"))
    return means.select(
        "k", F.expr("stack(2, 'ndcg', 0, ndcg, 'map', 1, map) as (metric, metric_order, score)")
    ).select("metric", "metric_order", "k", "score")
