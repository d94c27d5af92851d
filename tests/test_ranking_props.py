"""Property test: every ranking metric equals a direct Python evaluation of its
definition on random graded lists (brute force on a small fixture)."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vireo.operators import ranking as R

lists_st = st.lists(st.lists(st.integers(min_value=0, max_value=4), min_size=1, max_size=12),
                    min_size=1, max_size=8)


def dcg(r, k, method):
    r = r[:k]
    if method == 0:
        return sum(v if i == 0 else v / math.log2(i + 1) for i, v in enumerate(r))
    return sum(v / math.log2(i + 2) for i, v in enumerate(r))


def brute(r, k):
    b = [1.0 if v >= 2 else 0.0 for v in r]
    prec = [sum(b[:i + 1]) / (i + 1) for i in range(len(b))]
    idcg = dcg(sorted(r, reverse=True), k, 0)
    rel = [i for i, x in enumerate(b) if x]
    return {
        "ndcg": 0.0 if idcg == 0 else dcg(r, k, 0) / idcg,
        "ap_prefix": sum(prec[:k]) / min(k, len(r)),
        "ap": sum(prec[i] for i in rel) / len(rel) if rel else 0.0,
        "rr": 1.0 / (rel[0] + 1) if rel else 0.0,
        "rp": len(rel) / (rel[-1] + 1) if rel else 0.0,
    }


@settings(max_examples=4, deadline=None)
@given(lists_st, st.integers(min_value=1, max_value=6))
def test_metrics_match_definitions(spark, lists, k):
    rows = [(q, i, float(v)) for q, lst in enumerate(lists) for i, v in enumerate(lst)]
    df = spark.createDataFrame(rows, "q long, o int, rel double")
    rk = R.rank_lists(df, "q", ["o"], "rel", relevant=R.binarize(F.col("rel"), 2.0))
    got = {}
    for name, frame, col in (("ndcg", R.ndcg_at_k(rk, "q", k), "ndcg"),
                             ("ap_prefix", R.average_precision_prefix(rk, "q", k), "ap"),
                             ("ap", R.average_precision(rk, "q"), "ap"),
                             ("rr", R.reciprocal_rank(rk, "q"), "rr"),
                             ("rp", R.r_precision(rk, "q"), "r_precision")):
        for r in frame.collect():
            got[(name, r["q"])] = r[col]
    for q, lst in enumerate(lists):
        exp = brute(lst, k)
        for name, v in exp.items():
            assert math.isclose(got[(name, q)], v, rel_tol=1e-9, abs_tol=1e-12), (name, lst, k)
