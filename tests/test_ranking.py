"""Ranking metrics against the documented example values of the reference's
metric library, plus invariants of the skew-safe numbering.

Fixed values: the example lists and results are those that its documentation states."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vireo.operators import ranking as R
from vireo.operators.relational import first_in_group, ordered_prefix


def lists_df(spark, lists):
    rows = [(q, i + 1, float(v)) for q, lst in enumerate(lists) for i, v in enumerate(lst)]
    return spark.createDataFrame(rows, "q long, o int, rel double")


def ranked(spark, lists, relevant=None):
    return R.rank_lists(lists_df(spark, lists), "q", ["o"], "rel", relevant=relevant)


def per_query(df, col):
    return [r[col] for r in df.orderBy("q").collect()]


def test_mrr(spark):
    assert R.mean_reciprocal_rank(ranked(spark, [[0, 0, 1], [0, 1, 0], [1, 0, 0]]), "q").first()[0] \
        == pytest.approx(0.61111111111111105)
    assert R.mean_reciprocal_rank(ranked(spark, [[0, 0, 0], [0, 1, 0], [1, 0, 0]]), "q").first()[0] \
        == pytest.approx(0.5)
    assert R.mean_reciprocal_rank(ranked(spark, [[0, 0, 0, 1], [1, 0, 0], [1, 0, 0]]), "q").first()[0] \
        == pytest.approx(0.75)


def test_r_precision(spark):
    got = per_query(R.r_precision(ranked(spark, [[0, 0, 1], [0, 1, 0], [1, 0, 0]]), "q"), "r_precision")
    assert got == pytest.approx([0.33333333333333331, 0.5, 1.0])


def test_precision_at_k(spark):
    rk = ranked(spark, [[0, 0, 1]])
    assert [R.precision_at_k(rk, "q", k).first()[1] for k in (1, 2, 3)] == pytest.approx([0.0, 0.0, 1 / 3])
    assert R.precision_at_k(rk, "q", 4).first()[1] is None
    with pytest.raises(Exception, match="fewer than k rows"):
        R.precision_at_k(rk, "q", 4, strict=True).collect()


def test_average_precision_classic_and_map(spark):
    ap_list = [1, 1, 0, 1, 0, 1, 0, 0, 0, 1]
    assert R.average_precision(ranked(spark, [ap_list]), "q").first()["ap"] == pytest.approx(0.78333333333333333)
    assert R.mean_average_precision(ranked(spark, [ap_list]), "q").first()[0] == pytest.approx(0.78333333333333333)
    assert R.mean_average_precision(ranked(spark, [ap_list, [0]]), "q").first()[0] \
        == pytest.approx(0.39166666666666666)


def test_average_precision_prefix(spark):
    rk = ranked(spark, [[1, 1, 0, 1, 0, 1, 0, 0, 0, 1]])
    assert R.average_precision_prefix(rk, "q", 10).first()["ap"] == pytest.approx(0.669921, abs=1e-6)
    assert R.average_precision_prefix(rk, "q", 5).first()["ap"] == pytest.approx(0.803333, abs=1e-6)


def test_dcg(spark):
    rk = ranked(spark, [[3, 2, 3, 0, 0, 1, 2, 2, 3, 0]])
    assert R.dcg_at_k(rk, "q", 1).first()["dcg"] == pytest.approx(3.0)
    assert R.dcg_at_k(rk, "q", 1, method=1).first()["dcg"] == pytest.approx(3.0)
    assert R.dcg_at_k(rk, "q", 2).first()["dcg"] == pytest.approx(5.0)
    assert R.dcg_at_k(rk, "q", 2, method=1).first()["dcg"] == pytest.approx(4.2618595071429155)
    assert R.dcg_at_k(rk, "q", 10).first()["dcg"] == pytest.approx(9.6051177391888114)
    assert R.dcg_at_k(rk, "q", 11).first()["dcg"] == pytest.approx(9.6051177391888114)
    with pytest.raises(ValueError):
        R.dcg_at_k(rk, "q", 2, method=2)


def test_ndcg(spark):
    assert R.ndcg_at_k(ranked(spark, [[3, 2, 3, 0, 0, 1, 2, 2, 3, 0]]), "q", 1).first()["ndcg"] == pytest.approx(1.0)
    rk = ranked(spark, [[2, 1, 2, 0]])
    assert R.ndcg_at_k(rk, "q", 4).first()["ndcg"] == pytest.approx(0.9203032077642922)
    assert R.ndcg_at_k(rk, "q", 4, method=1).first()["ndcg"] == pytest.approx(0.96519546960144276)
    assert R.ndcg_at_k(ranked(spark, [[0]]), "q", 1).first()["ndcg"] == 0.0
    assert R.ndcg_at_k(ranked(spark, [[1]]), "q", 2).first()["ndcg"] == pytest.approx(1.0)


def test_numeric_ideal_order(spark):
    # 10 and 2: a text sort would put "2" first; the ideal order is numeric
    import math
    rk = ranked(spark, [[2, 10]])
    expect = (2 + 10 / math.log2(3)) / (10 + 2 / math.log2(3))
    assert R.ndcg_at_k(rk, "q", 2, method=1).first()["ndcg"] == pytest.approx(expect)
    assert expect < 1.0


def test_sweep_matches_single_metrics(spark):
    lists = [[3, 2, 3, 0, 0, 1, 2, 2, 3, 0], [2, 1, 2, 0], [0], [1], [0, 0, 0]]
    rk = ranked(spark, lists, relevant=R.binarize(F.col("rel"), 2.0))
    pq = {(r["q"], r["k"]): r for r in R.per_query_sweep(rk, "q").collect()}
    for k in range(1, 6):
        nd = {r["q"]: r["ndcg"] for r in R.ndcg_at_k(rk, "q", k).collect()}
        ap = {r["q"]: r["ap"] for r in R.average_precision_prefix(rk, "q", k).collect()}
        for q in range(len(lists)):
            assert pq[(q, k)]["ndcg"] == pytest.approx(nd[q])
            assert pq[(q, k)]["ap"] == pytest.approx(ap[q])
    sweep = R.eval_sweep(rk, "q").collect()
    assert len(sweep) == 10
    assert all(0.0 <= r["score"] <= 1.0 for r in sweep)


def test_ideal_list_scores_one(spark):
    rk = ranked(spark, [[4, 3, 2, 1, 0]])
    assert R.ndcg_at_k(rk, "q", 5).first()["ndcg"] == pytest.approx(1.0)


def test_ordered_prefix_hot_group_equals_window(spark):
    # one group holds ~third of the rows
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
        F.col("id").alias("o"), (F.col("id") % 7).cast("double").alias("x"))
    a = ordered_prefix(df, ["g"], ["o"], sums={"cx": F.col("x")}, num_partitions=8)
    w = Window.partitionBy("g").orderBy("o")
    b = df.withColumn("pos", F.row_number().over(w).cast("long")).withColumn("cx", F.sum("x").over(w))
    assert sorted(map(tuple, a.select("g", "o", "pos", "cx").collect())) == \
        sorted(map(tuple, b.select("g", "o", "pos", "cx").collect()))
    # hot group spread over several range partitions
    parts = df.repartitionByRange(8, "g", "o").filter(F.col("g") == 0) \
        .select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_null_groups_are_numbered_and_first_rows_agree(spark):
    # a third of all rows in one group, a quarter without a group
    df = spark.range(0, 4000).select(
        F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
        F.col("id").alias("o"), (F.col("id") % 7).cast("double").alias("x"))
    full = ordered_prefix(df, ["g"], ["o"], sums={"cx": F.col("x")}, num_partitions=8)
    assert full.count() == 4000 and dict(full.dtypes)["pos"] == "bigint"
    nulls = full.where("g IS NULL").orderBy("o").collect()
    assert [r["pos"] for r in nulls] == list(range(1, 1001))
    top = first_in_group(df, ["g"], ["o"], 5, sums={"cx": F.col("x")})
    want = full.where("pos <= 5").select(top.columns)
    assert sorted(map(str, top.collect())) == sorted(map(str, want.collect()))


def test_relevant_rank_counts_instead_of_numbering(spark):
    lists = [[0, 0, 1, 0, 1], [0, 0], [1, 0]]
    df = lists_df(spark, lists)
    first = {r["q"]: r["pos"] for r in R.relevant_rank(df, "q", ["o"], R.nonzero("rel")).collect()}
    last = {r["q"]: (r["pos"], r["hits"]) for r in R.relevant_rank(df, "q", ["o"], R.nonzero("rel"), last=True).collect()}
    qs = sorted(first)
    assert [first[q] for q in qs] == [3, None, 1] and [last[q] for q in qs] == [(5, 2.0), (None, 0.0), (1, 1.0)]


def test_ordered_prefix_global(spark):
    df = spark.range(0, 1000).select((999 - F.col("id")).alias("o"))
    out = ordered_prefix(df, [], ["o"]).select("o", "pos").collect()
    assert all(r["pos"] == r["o"] + 1 for r in out)


def test_explode_lists_from_strings_and_arrays(spark):
    s = spark.createDataFrame([(1, "3 2 3 0 0 1 2 2 3 0"), (2, "2 1 2 0")], "q long, scores string")
    rk = R.rank_lists(R.explode_lists(s, "q", "scores"), "q", ["o"], "rel")
    got = {r["q"]: r["ndcg"] for r in R.ndcg_at_k(rk, "q", 4).collect()}
    assert got[2] == pytest.approx(0.9203032077642922)
    a = spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 0.0, 0.0])],
                              "q long, scores array<double>")
    rk2 = R.rank_lists(R.explode_lists(a, "q", "scores"), "q", ["o"], "rel")
    assert R.mean_reciprocal_rank(rk2, "q").first()[0] == pytest.approx(0.61111111111111105)
