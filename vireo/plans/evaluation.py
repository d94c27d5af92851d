"""Ranking-evaluation plans on ``orders``: query = customer, rank by
(order date, order key), graded relevance = 5 - leading digit of the priority
(0..4), relevant = relevance >= 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import resampling as RS
from ..sources import load_table

QUERY = "o_custkey"
ORDER = ["o_orderdate", "o_orderkey"]
REPLICATES = 200


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority"])
    rel = (F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int")).cast("double")
    return o.select(QUERY, *ORDER, rel.alias("relevance"))


def ranked(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    ev = evaluation_rows(spark, sf_dir)
    return R.rank_lists(ev, QUERY, ORDER, "relevance", relevant=R.binarize(F.col("rel"), 2.0), k=k)


def q_rank_lists(spark, sf_dir):
    return ranked(spark, sf_dir).select(QUERY, "pos", "rel")


def source(spark, sf_dir):
    return evaluation_rows(spark, sf_dir).select(QUERY, F.col("relevance").alias("rel"))


def q_ndcg_at_k(spark, sf_dir, k=5, method=0):
    out = R.ndcg_at_k(ranked(spark, sf_dir, k), QUERY, k, method, source=source(spark, sf_dir))
    return out.select(QUERY, F.round("ndcg", 6).alias("ndcg"))


def q_ndcg_at_k_m1(spark, sf_dir):
    return q_ndcg_at_k(spark, sf_dir, 5, 1)


def q_dcg_at_k(spark, sf_dir, k=5, method=0):
    out = R.dcg_at_k(ranked(spark, sf_dir, k), QUERY, k, method)
    return out.select(QUERY, F.round("dcg", 6).alias("dcg"))


def q_dcg_at_k_m1(spark, sf_dir):
    return q_dcg_at_k(spark, sf_dir, 5, 1)


def _relevant_rank(spark, sf_dir, last=False):
    return R.relevant_rank(evaluation_rows(spark, sf_dir), QUERY, ORDER, R.binarize("relevance", 2.0), last)


def q_mrr(spark, sf_dir):
    rr = F.coalesce(F.lit(1.0) / F.col("pos"), F.lit(0.0))
    return _relevant_rank(spark, sf_dir).select(QUERY, F.round(rr, 6).alias("rr"))


def q_mrr_mean(spark, sf_dir):
    rr = F.coalesce(F.lit(1.0) / F.col("pos"), F.lit(0.0))
    return _relevant_rank(spark, sf_dir).agg(F.round(F.avg(rr), 6).alias("mrr"))


def q_r_precision(spark, sf_dir):
    rp = F.coalesce(F.col("hits") / F.col("pos"), F.lit(0.0))
    return _relevant_rank(spark, sf_dir, last=True).select(QUERY, F.round(rp, 6).alias("r_precision"))


def q_precision_at_k(spark, sf_dir, k=3):
    out = R.precision_at_k(ranked(spark, sf_dir, k), QUERY, k)
    return out.select(QUERY, F.round("precision_at_k", 6).alias("precision_at_k"))


def q_ap_prefix_at_k(spark, sf_dir, k=5):
    out = R.average_precision_prefix(ranked(spark, sf_dir, k), QUERY, k)
    return out.select(QUERY, F.round("ap", 6).alias("ap"))


def q_ap_classic(spark, sf_dir):
    out = R.average_precision(ranked(spark, sf_dir), QUERY)
    return out.select(QUERY, F.round("ap", 6).alias("ap"))


def q_mean_average_precision(spark, sf_dir):
    out = R.mean_average_precision(ranked(spark, sf_dir), QUERY)
    return out.select(F.round("map", 6).alias("map"))


def q_prefix_precision(spark, sf_dir):
    out = R.prefix_precision(ranked(spark, sf_dir))
    return out.select(QUERY, "pos", F.round("precision", 6).alias("precision"))


def q_eval_sweep(spark, sf_dir):
    out = R.eval_sweep(ranked(spark, sf_dir, 5), QUERY, ks=(1, 2, 3, 4, 5), method=0,
                       source=source(spark, sf_dir))
    return out.select("metric", "k", F.round("score", 6).alias("score"))


def _bootstrap(spark, sf_dir):
    """Means of nDCG@5 and AP@5 in 200 samples of the customers, drawn with replacement."""
    per = R.per_query_sweep(ranked(spark, sf_dir, 5), QUERY, ks=(5,), source=source(spark, sf_dir))
    return RS.bootstrap_means(per.select(QUERY, "ndcg", "ap"), QUERY, ["ndcg", "ap"], REPLICATES)


def q_bootstrap_means(spark, sf_dir):
    return _bootstrap(spark, sf_dir).select("replicate", "n", F.round("ndcg", 6).alias("ndcg"), F.round("ap", 6).alias("ap"))


def q_bootstrap_intervals(spark, sf_dir):
    out = RS.bootstrap_intervals(_bootstrap(spark, sf_dir), ["ndcg", "ap"])
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


# Shared SQL for the oracle: same mapping in DuckDB.
_RANKED_SQL = """
WITH ev AS (
  SELECT o_custkey, o_orderdate, o_orderkey,
         CAST(5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS DOUBLE) AS rel
  FROM orders),
rk AS (
  SELECT o_custkey, rel,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos,
         CASE WHEN rel >= 2 THEN 1.0 ELSE 0.0 END AS bin
  FROM ev),
ranked AS (
  SELECT *, sum(bin) OVER (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_bin
  FROM rk)
"""


def _disc(pos: str, method: int) -> str:
    return f"(1.0 / greatest(1.0, log2({pos})))" if method == 0 else f"(1.0 / log2({pos} + 1))"


def _ndcg_sql(k: int, method: int) -> str:
    return _RANKED_SQL + f"""
, ideal AS (
  SELECT o_custkey, rel, row_number() OVER (PARTITION BY o_custkey ORDER BY rel DESC, pos) AS ipos FROM ranked),
d AS (SELECT o_custkey, sum(CASE WHEN pos <= {k} THEN rel * {_disc('pos', method)} ELSE 0 END) AS dcg FROM ranked GROUP BY o_custkey),
i AS (SELECT o_custkey, sum(CASE WHEN ipos <= {k} THEN rel * {_disc('ipos', method)} ELSE 0 END) AS idcg FROM ideal GROUP BY o_custkey)
SELECT d.o_custkey, round(CASE WHEN idcg = 0 THEN 0.0 ELSE dcg / idcg END, 6) AS ndcg
FROM d JOIN i USING (o_custkey)
"""


def _dcg_sql(k: int, method: int) -> str:
    return _RANKED_SQL + f"""
SELECT o_custkey, round(sum(rel * {_disc('pos', method)}), 6) AS dcg
FROM ranked WHERE pos <= {k} GROUP BY o_custkey
"""


ORACLE = {
    "rank_lists": _RANKED_SQL + "SELECT o_custkey, pos, rel FROM ranked",
    "ndcg_at_k": _ndcg_sql(5, 0),
    "ndcg_at_k_m1": _ndcg_sql(5, 1),
    "dcg_at_k": _dcg_sql(5, 0),
    "dcg_at_k_m1": _dcg_sql(5, 1),
    "mrr": _RANKED_SQL + """
SELECT o_custkey, round(coalesce(1.0 / min(CASE WHEN bin > 0 THEN pos END), 0.0), 6) AS rr
FROM ranked GROUP BY o_custkey""",
    "mrr_mean": _RANKED_SQL + """
, rr AS (SELECT o_custkey, coalesce(1.0 / min(CASE WHEN bin > 0 THEN pos END), 0.0) AS rr FROM ranked GROUP BY o_custkey)
SELECT round(avg(rr), 6) AS mrr FROM rr""",
    "r_precision": _RANKED_SQL + """
SELECT o_custkey, round(coalesce(sum(bin) / max(CASE WHEN bin > 0 THEN pos END), 0.0), 6) AS r_precision
FROM ranked GROUP BY o_custkey""",
    "precision_at_k": _RANKED_SQL + """
SELECT o_custkey,
       round(CASE WHEN count(*) < 3 THEN NULL
                  ELSE sum(CASE WHEN pos <= 3 THEN bin ELSE 0.0 END) / 3.0 END, 6) AS precision_at_k
FROM ranked GROUP BY o_custkey""",
    "ap_prefix_at_k": _RANKED_SQL + """
SELECT o_custkey, round(avg(cum_bin / pos), 6) AS ap FROM ranked WHERE pos <= 5 GROUP BY o_custkey""",
    "ap_classic": _RANKED_SQL + """
SELECT o_custkey, round(coalesce(sum(CASE WHEN bin > 0 THEN cum_bin / pos END) / nullif(sum(bin), 0), 0.0), 6) AS ap
FROM ranked GROUP BY o_custkey""",
    "mean_average_precision": _RANKED_SQL + """
, ap AS (SELECT o_custkey, coalesce(sum(CASE WHEN bin > 0 THEN cum_bin / pos END) / nullif(sum(bin), 0), 0.0) AS ap
         FROM ranked GROUP BY o_custkey)
SELECT round(avg(ap), 6) AS map FROM ap""",
    "prefix_precision": _RANKED_SQL + "SELECT o_custkey, pos, round(cum_bin / pos, 6) AS precision FROM ranked",
    "eval_sweep": _RANKED_SQL + """
, ideal AS (
  SELECT o_custkey, rel, row_number() OVER (PARTITION BY o_custkey ORDER BY rel DESC, pos) AS ipos FROM ranked),
ks AS (SELECT unnest(range(1, 6)) AS k),
per AS (
  SELECT r.o_custkey, ks.k,
         sum(CASE WHEN r.pos <= ks.k THEN r.rel * (1.0 / greatest(1.0, log2(r.pos))) ELSE 0 END) AS dcg,
         avg(CASE WHEN r.pos <= ks.k THEN r.cum_bin / r.pos END) AS ap
  FROM ranked r, ks GROUP BY r.o_custkey, ks.k),
iper AS (
  SELECT i.o_custkey, ks.k,
         sum(CASE WHEN i.ipos <= ks.k THEN i.rel * (1.0 / greatest(1.0, log2(i.ipos))) ELSE 0 END) AS idcg
  FROM ideal i, ks GROUP BY i.o_custkey, ks.k),
q AS (
  SELECT per.k, CASE WHEN idcg = 0 THEN 0.0 ELSE dcg / idcg END AS ndcg, ap
  FROM per JOIN iper USING (o_custkey, k))
SELECT 'ndcg' AS metric, CAST(k AS INTEGER) AS k, round(avg(ndcg), 6) AS score FROM q GROUP BY k
UNION ALL
SELECT 'map' AS metric, CAST(k AS INTEGER) AS k, round(avg(ap), 6) AS score FROM q GROUP BY k
""",
}
_BOOTSTRAP_SQL = _RANKED_SQL + f"""
, ideal AS (
  SELECT o_custkey, rel, row_number() OVER (PARTITION BY o_custkey ORDER BY rel DESC, pos) AS ipos FROM ranked),
d AS (SELECT o_custkey, sum(rel * {_disc('pos', 0)}) AS dcg, avg(cum_bin / pos) AS ap FROM ranked WHERE pos <= 5 GROUP BY o_custkey),
i AS (SELECT o_custkey, sum(rel * {_disc('ipos', 0)}) AS idcg FROM ideal WHERE ipos <= 5 GROUP BY o_custkey),
per AS (SELECT o_custkey, CASE WHEN idcg = 0 THEN 0.0 ELSE dcg / idcg END AS ndcg, ap FROM d JOIN i USING (o_custkey)),
hashed AS (
  SELECT replicate, ndcg, ap, CAST('0x' || substr(md5(replicate || ':' || o_custkey), 1, 8) AS BIGINT) AS h
  FROM per, (SELECT unnest(range(0, {REPLICATES})) AS replicate)),
drawn AS (SELECT *, {" + ".join(f"CAST(h >= {x} AS BIGINT)" for x in RS.poisson_steps())} AS w FROM hashed),
means AS (
  SELECT CAST(replicate AS INTEGER) AS replicate, CAST(sum(w) AS BIGINT) AS n, sum(w * ndcg) / sum(w) AS ndcg, sum(w * ap) / sum(w) AS ap
  FROM drawn GROUP BY replicate HAVING sum(w) > 0)
"""
ORACLE["bootstrap_means"] = _BOOTSTRAP_SQL + "SELECT replicate, n, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap FROM means"
ORACLE["bootstrap_intervals"] = _BOOTSTRAP_SQL + " UNION ALL ".join(f"""
SELECT '{m}' AS metric, round(quantile_cont({m}, 0.025), 6) AS low, round(quantile_cont({m}, 0.5), 6) AS median,
       round(quantile_cont({m}, 0.975), 6) AS high FROM means""" for m in ("ndcg", "ap"))

QUERIES = {
    "rank_lists": q_rank_lists,
    "ndcg_at_k": q_ndcg_at_k,
    "ndcg_at_k_m1": q_ndcg_at_k_m1,
    "dcg_at_k": q_dcg_at_k,
    "dcg_at_k_m1": q_dcg_at_k_m1,
    "mrr": q_mrr,
    "mrr_mean": q_mrr_mean,
    "r_precision": q_r_precision,
    "precision_at_k": q_precision_at_k,
    "ap_prefix_at_k": q_ap_prefix_at_k,
    "ap_classic": q_ap_classic,
    "mean_average_precision": q_mean_average_precision,
    "prefix_precision": q_prefix_precision,
    "eval_sweep": q_eval_sweep,
    "bootstrap_means": q_bootstrap_means,
    "bootstrap_intervals": q_bootstrap_intervals,
}
