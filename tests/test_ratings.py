"""Ratings readers, RMSE denominators, baselines and ALS on a low-rank set."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.operators import recommend as RC
from vireo.sources import ratings as RS


def test_parse_ratings_modes(spark):
    lines = spark.createDataFrame([("1,10,4.5,1234567891",), ("2::x",), ("3,11,abc,17",), (" 4,12,0,20 ",)],
                                  "value string")
    ok = RS.parse_ratings(lines, ",", "DROPMALFORMED").collect()
    assert [(r.user, r.item, r.rating, r.fold) for r in ok] == [(1, 10, 4.5, 1), (4, 12, 0.0, 0)]
    assert RS.parse_ratings(lines, ",", "PERMISSIVE").count() == 4
    with pytest.raises(Exception, match="Malformed"):
        RS.parse_ratings(lines, ",", "FAILFAST").collect()
    dc = spark.createDataFrame([("5::13::3.0::99",)], "value string")
    assert RS.parse_ratings(dc, "::").first().asDict() == {"user": 5, "item": 13, "rating": 3.0, "fold": 9}


def test_zero_rating_dropped(spark):
    r = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 3.0, 1)], "user long, item int, rating double, fold int")
    assert RS.positive(r).count() == 1


def test_titles_keep_quoted_commas(spark):
    lines = spark.createDataFrame([('1,"Heat, The (1995)",Drama',), ("2,Plain,Comedy",), ("bad",)],
                                  "value string")
    out = {r.item: r.title for r in RS.parse_titles(lines).collect()}
    assert out == {1: "Heat, The (1995)", 2: "Plain"}


def test_rmse_denominators_and_cold_user(spark):
    actual = spark.createDataFrame([(1, 1, 3.0), (1, 2, 5.0), (9, 1, 4.0)], "user long, item int, rating double")
    pred = spark.createDataFrame([(1, 4.0)], "user long, prediction double")
    r = RC.rmse(actual, pred, on=["user"]).first()
    assert r["n_scored"] == 2 and r["n"] == 3
    assert r["rmse"] == pytest.approx(1.0)
    assert r["rmse_all"] == pytest.approx(math.sqrt(2.0 / 3.0))
    j = RC.join_predictions(spark.createDataFrame([(1, 1, 4.0)], "user long, item int, prediction double"),
                            actual.unionByName(actual))
    assert j.count() == 2  # duplicate pairs multiply


def test_baseline_and_improvement(spark):
    tv = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0)], "user long, item int, rating double")
    test = spark.createDataFrame([(1, 3, 5.0), (2, 3, 1.0)], "user long, item int, rating double")
    b = RC.mean_baseline_rmse(tv, test).first()
    assert b["mean_rating"] == pytest.approx(3.0)
    assert b["baseline_rmse"] == pytest.approx(2.0)
    pred = spark.createDataFrame([(1, 5.0), (2, 1.0)], "user long, prediction double")
    imp = RC.improvement(tv, test, pred).first()
    assert imp["improvement_pct"] == pytest.approx(100.0)


def test_grid_argmin_first_wins(spark):
    train = spark.createDataFrame([(1, 1, 4.0), (2, 1, 4.0), (3, 2, 2.0)], "user long, item int, rating double")
    valid = spark.createDataFrame([(4, 1, 4.0), (5, 2, 2.0)], "user long, item int, rating double")
    g = RC.damped_item_mean_grid(train, valid, [0.0, 0.0, 5.0]).orderBy("grid_pos").collect()
    assert [r["is_best"] for r in g] == [True, False, False]
    assert g[0]["val_rmse"] == pytest.approx(0.0)


def test_fold_split(spark):
    r = spark.createDataFrame([(1, 1, 1.0, f) for f in range(10)], "user long, item int, rating double, fold int")
    got = {x["split"]: x["n"] for x in RC.fold_split_counts(r).collect()}
    assert got == {"train": 6, "validation": 2, "test": 2}


def test_als_beats_mean_on_low_rank(spark):
    rng = np.random.default_rng(0)
    u = rng.normal(size=(60, 2))
    v = rng.normal(size=(40, 2))
    rows = [(i, j, float(u[i] @ v[j] + 3.0), int(rng.integers(0, 10)))
            for i in range(60) for j in range(40) if rng.random() < 0.6]
    r = spark.createDataFrame(rows, "user long, item int, rating double, fold int")
    train, test = RC.split(r, "train"), RC.split(r, "test")
    m = RC.train_als(train, rank=4, max_iter=15, reg=0.01)
    model_rmse = RC.als_rmse(m, test).first()["rmse"]
    base = RC.mean_baseline_rmse(train, test).first()["baseline_rmse"]
    assert model_rmse < 0.5 * base
    loaded = RC.save_and_load(m)
    assert RC.als_predict(loaded, test).count() == RC.als_predict(m, test).count()
    recs = RC.recommend_unseen(m, r.select("item"), r, 0, n=5).collect()
    rated = {x.item for x in r.filter(F.col("user") == 0).collect()}
    assert len(recs) == min(5, 40 - len(rated)) and not ({x.item for x in recs} & rated)
    cand = spark.createDataFrame([(0, i) for i in range(40) if i not in rated], "user int, item int")
    brute = sorted(((-x.prediction, x.item) for x in RC.als_predict(m, cand).collect()))[:5]
    assert [x.item for x in recs] == [it for _, it in brute]
    assert [x.prediction for x in recs] == pytest.approx([-p for p, _ in brute], rel=1e-5)


def test_recommend_all_unseen_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(u, i, float(rng.integers(1, 6)), 0) for u in range(30) for i in range(25)
            if rng.random() < (0.95 if u == 0 else 0.3)]       # user 0 rated almost everything
    r = spark.createDataFrame(rows, "user long, item int, rating double, fold int")
    m = RC.train_als(r, rank=3, max_iter=5, reg=0.1)
    got = RC.recommend_all_unseen(m, r, n=3, first_k=4)
    # brute force: score every unseen pair, keep the best 3 per user
    users = [x.user for x in r.select("user").distinct().collect()]
    rated = {(x.user, x.item) for x in r.collect()}
    cand = spark.createDataFrame([(u, i) for u in users for i in range(25) if (u, i) not in rated],
                                 "user int, item int")
    scored = RC.als_predict(m, cand).collect()
    best = {}
    for x in scored:
        best.setdefault(x.user, []).append((-x.prediction, x.item))
    expect = {(u, it) for u, lst in best.items() for _, it in sorted(lst)[:3]}
    assert {(x.user, x.item) for x in got.collect()} == expect


def test_dense_ids_for_wide_keys(spark):
    big = 2**40
    r = spark.createDataFrame([(big + 5, 7), (big + 1, 7), (3, 9)], "user long, item int")
    m = {x.user: x.idx for x in RC.dense_ids(r, "user").collect()}
    assert m == {3: 0, big + 1: 1, big + 5: 2}


def test_als_with_wide_keys(spark):
    big = 2**40
    rng = np.random.default_rng(2)
    rows = [(big + u, big * 2 + i, float(rng.integers(1, 6))) for u in range(20) for i in range(10)
            if rng.random() < 0.7]
    r = spark.createDataFrame(rows, "user long, item long, rating double")
    m = RC.train_als_any_ids(r, rank=2, max_iter=3, reg=0.1)
    assert isinstance(m, RC.IndexedALSModel)
    out = RC.als_predict(m, r).collect()
    assert len(out) == len(rows)
    assert {(x.user, x.item) for x in out} == {(u, i) for u, i, _ in rows}


def test_recommendations_with_wide_keys(spark):
    big = 2**40
    rng = np.random.default_rng(3)
    rows = [(big + u, big * 2 + i, float(rng.integers(1, 6))) for u in range(15) for i in range(12)
            if rng.random() < 0.5]
    r = spark.createDataFrame(rows, "user long, item long, rating double")
    m = RC.train_als_any_ids(r, rank=2, max_iter=3, reg=0.1)
    rated = {(u, i) for u, i, _ in rows}
    # one user: equals brute-force scoring of the unseen items
    items = spark.createDataFrame([(big * 2 + i,) for i in range(12)], "item long")
    one = RC.recommend_unseen(m, items, r, big + 0, n=3).collect()
    cand = spark.createDataFrame([(big + 0, big * 2 + i) for i in range(12) if (big, big * 2 + i) not in rated],
                                 "user long, item long")
    brute = sorted((-x.prediction, x.item) for x in RC.als_predict(m, cand).collect())[:3]
    assert [x.item for x in one] == [it for _, it in brute]
    # all users: wide keys come back, no rated pair, n per user (every user has >= 3 unseen here)
    allr = RC.recommend_all_unseen(m, r, n=3).collect()
    assert all(x.user >= big and x.item >= 2 * big and (x.user, x.item) not in rated for x in allr)
    per = {}
    for x in allr:
        per[x.user] = per.get(x.user, 0) + 1
    assert set(per.values()) == {3}


def test_ids_beyond_31_bits_are_read(spark):
    lines = spark.createDataFrame([("1,3000000000,4.5,12345",)], "value string")
    assert [tuple(r) for r in RS.parse_ratings(lines).collect()] == [(1, 3000000000, 4.5, 5)]
    titles = spark.createDataFrame([("3000000000,Big",)], "value string")
    assert [tuple(r) for r in RS.parse_titles(titles).collect()] == [(3000000000, "Big")]


def test_holdout_rows_are_not_trained_on(spark, sf_small):
    from vireo.plans import ratings as P
    r, train = P._als_data(spark, sf_small)
    assert r.filter(F.col("user") == P.PERSONAL_USER).count() == 0
    key = ["user", "item", "rating"]
    n = RC.split(r, "train").count() + P.personal(spark, sf_small).count()
    assert train.count() == n
    assert P.ratings(spark, sf_small).count() == r.count() + P.personal(spark, sf_small).count()
    assert train.select(key).exceptAll(P.ratings(spark, sf_small).select(key)).count() == 0


def test_factors_solve_their_normal_equations(spark):
    rng = np.random.default_rng(4)
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(20) for i in range(15) if rng.random() < 0.6]
    r = spark.createDataFrame(rows, "user long, item long, rating double")
    m = RC.train_als(r, rank=3, max_iter=4, reg=0.1)
    assert max(x["gap"] for x in RC.normal_equation_gap(m, r, 0.1).collect()) < 1e-3
    assert max(x["gap"] for x in RC.normal_equation_gap(m, r, 5.0).collect()) > 1e-2


def test_require_non_empty(spark):
    from vireo.sources import require_non_empty
    assert require_non_empty(spark.range(1)).count() == 1
    with pytest.raises(ValueError, match="No rows in ratings"):
        require_non_empty(spark.range(0), "ratings")
