"""Rating and recommendation plans on ``events`` (user = user_id, item = props.k,
rating = value, fold = second(ts) % 10) with item titles from ``part``.

The reference scores a user whose own ratings come from a separate file. Here
that user is user 0: its events are the personal ratings, and ``others`` (the
rating table without them) is what is split into folds, so no row is both
trained on and tested, and none is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_only
from ..functions.vectors import dot
from ..operators import als_path as AP
from ..operators import recommend as RC
from ..sources import load_table
from ..sources import ratings as RS

PERSONAL_USER = 0
TOP_N = 50
LAMBDAS = (0.0, 1.0, 2.0, 5.0, 10.0, 25.0)


def ratings(spark, sf_dir) -> DataFrame:
    ev = load_table(spark, sf_dir, "events", ["user_id", "props", "value", "ts"])
    return RS.positive(RS.events_as_ratings(ev))


def titles(spark, sf_dir) -> DataFrame:
    return load_table(spark, sf_dir, "part", ["p_partkey", "p_name"]) \
        .select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"))


def personal(spark, sf_dir) -> DataFrame:
    return ratings(spark, sf_dir).filter(F.col("user") == PERSONAL_USER)


def others(spark, sf_dir) -> DataFrame:
    return ratings(spark, sf_dir).filter(F.col("user") != PERSONAL_USER)


def q_fold_split_counts(spark, sf_dir):
    return RC.fold_split_counts(ratings(spark, sf_dir))


def q_dataset_profile(spark, sf_dir):
    return RC.dataset_profile(ratings(spark, sf_dir))


def q_positive_ratings(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events", ["user_id", "props", "value", "ts"])
    out = RS.positive(RS.events_as_ratings(ev))
    return out.select("user", "item", "rating", "fold")


def rating_lines(spark, sf_dir) -> DataFrame:
    """Rating lines of all events; by ``event_id`` modulo 11 some lack a field or hold one that is no number."""
    ev = load_table(spark, sf_dir, "events", ["event_id", "user_id", "props", "value", "ts"])
    r = ev.select("event_id", F.col("user_id").cast("string").alias("u"), F.get_json_object("props", "$.k").alias("i"),
                  F.col("value").cast("string").alias("r"), RS.epoch_seconds(F.col("ts")).cast("string").alias("t"))
    m = F.pmod("event_id", F.lit(11))
    line = F.when(m == 3, F.concat_ws(",", "u", "i", "r")).when(m == 5, F.concat_ws(",", F.lit("x"), "i", "r", "t")) \
        .when(m == 7, F.concat_ws(",", "u", "i", F.lit("n/a"), "t")).when(m == 9, F.concat_ws(",", "u", "i", "r", F.lit("now"))) \
        .otherwise(F.concat_ws(",", "u", "i", "r", "t"))
    return r.select(line.alias("value"))


def q_quarantine_good(spark, sf_dir):
    lines = rating_lines(spark, sf_dir)
    good, _ = RS.quarantine(lines, RS.rating_reason(F.col("value")))
    return RS.parse_ratings(good, mode="FAILFAST").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"), F.sum("item").alias("items"))


def q_quarantine_rejected(spark, sf_dir):
    _, bad = RS.quarantine(rating_lines(spark, sf_dir), RS.rating_reason(F.col("value")))
    return bad.select("reason", F.size(F.split("value", ",")).alias("fields")).groupBy("reason", "fields").agg(F.count(F.lit(1)).alias("n"))


def q_train_union_personal(spark, sf_dir):
    return RC.with_personal(RC.split(others(spark, sf_dir), "train"), personal(spark, sf_dir))


def _user_mean_scored_test(spark, sf_dir):
    r = ratings(spark, sf_dir)
    model = RC.user_mean_predictor(RC.split(r, "train"))
    test = RC.split(r, "test")
    return model, test


def q_join_predictions_actuals(spark, sf_dir):
    model, test = _user_mean_scored_test(spark, sf_dir)
    preds = RC.predict_pairs(model, test, ["user"])
    j = RC.join_predictions(preds, test.select("user", "item", "rating"))
    return j.select("user", "item", F.round("prediction", 6).alias("prediction"), "rating")


def q_rmse_predictions(spark, sf_dir):
    model, test = _user_mean_scored_test(spark, sf_dir)
    out = RC.rmse(test.select("user", "item", "rating"), model, on=["user"])
    return out.select(F.round("rmse", 6).alias("rmse"), "n_scored")


def q_rmse_all_denominator(spark, sf_dir):
    model, test = _user_mean_scored_test(spark, sf_dir)
    out = RC.rmse(test.select("user", "item", "rating"), model, on=["user"])
    return out.select(F.round("rmse_all", 6).alias("rmse_all"), "n")


def q_mean_baseline_rmse(spark, sf_dir):
    r = ratings(spark, sf_dir)
    tv = RC.split(r, "train").unionByName(RC.split(r, "validation"))
    out = RC.mean_baseline_rmse(tv, RC.split(r, "test"))
    return out.select(F.round("mean_rating", 6).alias("mean_rating"),
                      F.round("baseline_rmse", 6).alias("baseline_rmse"))


def q_improvement_pct(spark, sf_dir):
    r = ratings(spark, sf_dir)
    tv = RC.split(r, "train").unionByName(RC.split(r, "validation"))
    model = RC.user_mean_predictor(RC.split(r, "train"))
    out = RC.improvement(tv, RC.split(r, "test"), model, on=["user"])
    return out.select(*[F.round(c, 6).alias(c) for c in ("model_rmse", "baseline_rmse", "improvement_pct")])


def _lines(spark, sf_dir, sep):
    """Rating text lines derived from events; 'error' events carry a broken rating."""
    ev = load_table(spark, sf_dir, "events", ["user_id", "props", "value", "ts", "event_type"])
    rating_txt = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return ev.select(F.concat_ws(sep, F.col("user_id").cast("string"),
                                 F.get_json_object("props", "$.k"), rating_txt,
                                 RS.epoch_seconds(F.col("ts")).cast("string")).alias("value"))


def q_parse_ratings_csv(spark, sf_dir):
    return RS.parse_ratings(_lines(spark, sf_dir, ","), sep=",", mode="DROPMALFORMED")


def q_parse_ratings_double_colon(spark, sf_dir):
    return RS.parse_ratings(_lines(spark, sf_dir, "::"), sep="::", mode="DROPMALFORMED")


def q_parse_titles_csv(spark, sf_dir):
    p = load_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    lines = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), F.col("p_name"), F.lit(", "),
                              F.col("p_brand"), F.lit('",'), F.col("p_type")).alias("value"))
    return RS.parse_titles(lines)


def q_unseen_candidates(spark, sf_dir):
    rated = personal(spark, sf_dir).select("item").distinct()
    return titles(spark, sf_dir).join(rated, "item", "left_anti")


def q_top_n_with_titles(spark, sf_dir):
    r = ratings(spark, sf_dir)
    model = RC.item_mean_predictor(RC.split(r, "train"))
    rated = personal(spark, sf_dir).select("item").distinct()
    cand = titles(spark, sf_dir).join(rated, "item", "left_anti")
    scored = cand.join(model, "item", "inner")
    top = scored.orderBy(F.col("prediction").desc(), F.col("item")).limit(TOP_N)
    return _ranked(top).select("rank", "item", "title", F.round("prediction", 6).alias("score"))


def _ranked(top):
    """Rank numbers of at most TOP_N rows."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("prediction").desc(), F.col("item"))))


def q_ascii_strip(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents", ["doc_id", "text"])
    s = ascii_only("text")
    return d.select("doc_id", F.length(s).alias("ascii_len"), F.md5(s).alias("ascii_md5"))


def q_best_config(spark, sf_dir):
    r = ratings(spark, sf_dir)
    out = RC.damped_item_mean_grid(RC.split(r, "train"), RC.split(r, "validation"), LAMBDAS)
    return out.select("grid_pos", "lam", F.round("val_rmse", 6).alias("val_rmse"), "is_best")


# ---------------------------------------------------------------------- ALS

RANK, ITERATIONS, REG = 16, 7, 0.1
IMPLICIT_USERS = (0, 1, 2)


def _als_data(spark, sf_dir):
    r = others(spark, sf_dir)
    return r, RC.with_personal(RC.split(r, "train"), personal(spark, sf_dir))


def _fit(train, **kw):
    return RC.train_als(train, rank=RANK, max_iter=ITERATIONS, reg=REG, **kw)


def q_als_explicit_holdout(spark, sf_dir):
    """Rows and scored rows of each split, and whether the model beats the mean of what it was trained on."""
    r, train = _als_data(spark, sf_dir)
    parts = r.select("user", "item", "rating", RC.split_label().alias("split")).where("split <> 'train'") \
        .unionByName(train.withColumn("split", F.lit("train")))
    out = RC.als_split_rmse(_fit(train), parts)
    mean = train.select(F.stddev_pop("rating")).scalar()             # RMSE of always predicting the mean
    return out.select("split", "n", "n_scored", F.when(F.col("split") == "train", F.col("rmse") < mean).alias("beats_mean"))


def q_als_grid_search(spark, sf_dir):
    """Every grid point with finite errors, one of them marked best, and that one the argmin."""
    r, train = _als_data(spark, sf_dir)
    rows, best = RC.als_grid_search(train, RC.split(r, "validation").select("user", "item", "rating"),
                                    ranks=(8, 16), lambdas=(0.1,), iters=(7,), parallelism=2)
    grid = spark.createDataFrame(rows, "grid_pos int, lam double, rank int, iters int, "
                                       "train_rmse double, val_rmse double, is_best boolean")
    least = grid.select(F.min_by("grid_pos", F.struct("val_rmse", "grid_pos"))).scalar()
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)
    return grid.select("grid_pos", "lam", "rank", "iters", (finite("train_rmse") & finite("val_rmse")).alias("finite"),
                       (F.col("is_best") == (F.col("grid_pos") == least)).alias("best_is_argmin"))


PATH_RANKS, PATH_LAMBDAS, PATH_ITERATIONS = (2, 4, 8, 16), (0.01, 0.5, 0.1, 0.2, 0.4), 12       # fixed values: the grid


def q_als_validation_path(spark, sf_dir):
    """The whole grid of 240 points: rows scored, whether errors are finite, the objective never rises and the best is the argmin."""
    r, train = _als_data(spark, sf_dir)
    points, _, _ = AP.validation_path(train, RC.split(r, "validation"), PATH_RANKS, PATH_LAMBDAS, PATH_ITERATIONS)
    mean = train.select(F.stddev_pop("rating")).scalar()
    least = points.select(F.min("val_rmse")).scalar()
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)
    return AP.with_descent(points).select(
        "grid_pos", "lam", "rank", "iters", "n_scored", (finite("train_rmse") & finite("val_rmse")).alias("finite"), "descends",
        F.when(F.col("lam") < 0.05, F.col("train_rmse") < mean).alias("beats_mean"),
        (F.col("is_best") == (F.col("val_rmse") == least)).alias("best_is_argmin"))


def _checked(recs, model, items, rated, user):
    """One row: how many items were recommended, and whether they are unseen, in order and scored by the factors."""
    seen = rated.filter(F.col("user") == user).select("item").distinct().withColumn("_seen", F.lit(True))
    x = model.userFactors.filter(F.col("id") == user).select("features").scalar()
    y = model.itemFactors.select(F.col("id").alias("item"), F.col("features").alias("_y"))
    rows = _ranked(recs).join(seen, "item", "left").join(y, "item").withColumn("_x", x)
    below = F.lead("prediction").over(Window.orderBy("rank"))
    rows = rows.withColumn("_next", below).join(items.select("item", "title"), "item", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_seen"), 1)).alias("n_seen"),
                    F.bool_and(F.coalesce(F.col("prediction") >= F.col("_next"), F.lit(True))).alias("ordered"),
                    F.bool_and(F.abs(dot("_x", "_y") - F.col("prediction")) < 1e-4).alias("scores_match"),
                    F.count(ascii_only("title")).alias("n_titles"))


def q_als_recommend_unseen(spark, sf_dir):
    _, train = _als_data(spark, sf_dir)
    m, items, mine = _fit(train), titles(spark, sf_dir), personal(spark, sf_dir)
    return _checked(RC.recommend_unseen(m, items, mine, PERSONAL_USER, TOP_N), m, items, mine, PERSONAL_USER)


def q_als_factors(spark, sf_dir):
    """Every id that was trained on, the length of its vector, and, for users,
    whether it solves its normal equations given the item factors."""
    _, train = _als_data(spark, sf_dir)
    m = _fit(train)
    gap = RC.normal_equation_gap(m, train, REG)
    u = m.userFactors.join(gap, F.col("id") == F.col("user"), "left").select(
        F.lit("user").alias("kind"), "id", F.size("features").alias("length"), (F.col("gap") < 1e-3).alias("solves"))
    i = m.itemFactors.select(F.lit("item").alias("kind"), "id", F.size("features").alias("length"), F.lit(None).cast("boolean").alias("solves"))
    return u.unionByName(i).withColumn("id", F.col("id").cast("long"))


def q_als_save_load(spark, sf_dir):
    """Test rows that both the fitted and the reloaded model score, and whether they agree."""
    r, train = _als_data(spark, sf_dir)
    m = _fit(train)
    first = RC.als_predict(m, RC.split(r, "test").select("user", "item", "rating")).withColumnRenamed("prediction", "fitted")
    both = RC.als_predict(RC.save_and_load(m), first)
    return both.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"),
                       (F.col("prediction") == F.col("fitted")).alias("same_prediction"))


def q_als_implicit(spark, sf_dir):
    """An implicit model's recommendations for a named set of users, checked as for the explicit one."""
    _, train = _als_data(spark, sf_dir)
    m, items = _fit(train, implicit=True, alpha=1.0), titles(spark, sf_dir)
    out = None
    for u in IMPLICIT_USERS:
        one = _checked(RC.recommend_unseen(m, items, train, u, TOP_N), m, items, train, u).select(F.lit(u).alias("user"), "n", "n_seen", "ordered", "scores_match")
        out = one if out is None else out.unionByName(one)
    return out


_R = f"""
WITH r AS (
  SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, value AS rating,
         CAST(second(ts) % 10 AS INTEGER) AS fold
  FROM events WHERE value > 0),
train AS (SELECT * FROM r WHERE fold < 6),
valid AS (SELECT * FROM r WHERE fold >= 6 AND fold < 8),
test AS (SELECT * FROM r WHERE fold >= 8),
personal AS (SELECT * FROM r WHERE "user" = {PERSONAL_USER}),
umean AS (SELECT "user", avg(rating) AS prediction FROM train GROUP BY "user")
"""

ORACLE = {
    "fold_split_counts": _R + """
SELECT CASE WHEN fold < 6 THEN 'train' WHEN fold < 8 THEN 'validation' ELSE 'test' END AS split,
       count(*) AS n FROM r GROUP BY 1""",
    "dataset_profile": _R + """
SELECT count(*) AS n_ratings, count(DISTINCT "user") AS n_users, count(DISTINCT item) AS n_items FROM r""",
    "positive_ratings": _R + 'SELECT "user", item, rating, fold FROM r',
    "train_union_personal": _R + """
SELECT "user", item, rating FROM train WHERE "user" <> {PERSONAL_USER}
UNION ALL SELECT "user", item, rating FROM personal""".replace("{PERSONAL_USER}", str(PERSONAL_USER)),
    "join_predictions_actuals": _R + """
, preds AS (SELECT p."user", p.item, u.prediction FROM (SELECT DISTINCT "user", item FROM test) p JOIN umean u USING ("user"))
SELECT preds."user", preds.item, round(prediction, 6) AS prediction, t.rating
FROM preds JOIN test t ON preds."user" = t."user" AND preds.item = t.item""",
    "rmse_predictions": _R + """
SELECT round(sqrt(avg(pow(u.prediction - t.rating, 2))), 6) AS rmse, count(*) AS n_scored
FROM test t JOIN umean u USING ("user")""",
    "rmse_all_denominator": _R + """
SELECT round(sqrt(coalesce(sum(pow(u.prediction - t.rating, 2)), 0) / count(*)), 6) AS rmse_all, count(*) AS n
FROM test t LEFT JOIN umean u USING ("user")""",
    "mean_baseline_rmse": _R + """
, mu AS (SELECT avg(rating) AS m FROM (SELECT rating FROM train UNION ALL SELECT rating FROM valid))
SELECT round(max(mu.m), 6) AS mean_rating, round(sqrt(avg(pow(mu.m - t.rating, 2))), 6) AS baseline_rmse
FROM test t, mu""",
    "improvement_pct": _R + """
, mu AS (SELECT avg(rating) AS m FROM (SELECT rating FROM train UNION ALL SELECT rating FROM valid)),
g AS (SELECT sqrt(sum(pow(u.prediction - t.rating, 2)) / count(*)) AS model_rmse,
             sqrt(sum(pow(mu.m - t.rating, 2)) / count(*)) AS baseline_rmse
      FROM test t LEFT JOIN umean u USING ("user") CROSS JOIN mu)
SELECT round(model_rmse, 6) AS model_rmse, round(baseline_rmse, 6) AS baseline_rmse,
       round((baseline_rmse - model_rmse) / baseline_rmse * 100, 6) AS improvement_pct FROM g""",
    "parse_ratings_csv": """
SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, value AS rating,
       CAST(CAST(floor(epoch(ts)) AS BIGINT) % 10 AS INTEGER) AS fold
FROM events WHERE event_type <> 'error'""",
    "parse_ratings_double_colon": """
SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, value AS rating,
       CAST(CAST(floor(epoch(ts)) AS BIGINT) % 10 AS INTEGER) AS fold
FROM events WHERE event_type <> 'error'""",
    "parse_titles_csv": """
SELECT CAST(p_partkey AS BIGINT) AS item, p_name || ', ' || p_brand AS title FROM part""",
    "unseen_candidates": _R + """
SELECT p_partkey AS item, p_name AS title FROM part
WHERE p_partkey NOT IN (SELECT item FROM personal)""",
    "top_n_with_titles": _R + f"""
, imean AS (SELECT item, avg(rating) AS prediction FROM train GROUP BY item),
cand AS (SELECT p_partkey AS item, p_name AS title FROM part WHERE p_partkey NOT IN (SELECT item FROM personal)),
s AS (SELECT c.item, c.title, i.prediction FROM cand c JOIN imean i ON c.item = i.item)
SELECT CAST(row_number() OVER (ORDER BY prediction DESC, item) AS INTEGER) AS rank, item, title,
       round(prediction, 6) AS score
FROM s ORDER BY prediction DESC, item LIMIT {TOP_N}""",
    "ascii_strip": """
SELECT doc_id, CAST(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS INTEGER) AS ascii_len,
       md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS ascii_md5 FROM documents""",
    "best_config": _R + f"""
, mu AS (SELECT avg(rating) AS m FROM train),
st AS (SELECT item, sum(rating - (SELECT m FROM mu)) AS dev, count(*) AS cnt FROM train GROUP BY item),
grid AS (SELECT * FROM (VALUES {", ".join(f"({i}, {float(l)})" for i, l in enumerate(LAMBDAS))}) g(grid_pos, lam)),
res AS (
  SELECT g.grid_pos, g.lam,
         sqrt(avg(pow((SELECT m FROM mu) + coalesce(s.dev / (s.cnt + g.lam), 0.0) - v.rating, 2))) AS val_rmse
  FROM valid v LEFT JOIN st s ON v.item = s.item CROSS JOIN grid g
  GROUP BY g.grid_pos, g.lam)
SELECT CAST(grid_pos AS INTEGER) AS grid_pos, CAST(lam AS DOUBLE) AS lam, round(val_rmse, 6) AS val_rmse,
       grid_pos = (SELECT arg_min(grid_pos, (val_rmse, grid_pos)) FROM res) AS is_best
FROM res""",
}

# what the ALS fits train on, and ids they know
_ALS = _R + f"""
, o AS (SELECT * FROM r WHERE "user" <> {PERSONAL_USER}),
fitted AS (SELECT "user", item, rating FROM o WHERE fold < 6 UNION ALL SELECT "user", item, rating FROM personal),
known AS (SELECT DISTINCT "user" FROM fitted), things AS (SELECT DISTINCT item FROM fitted)
"""


def _recommended(user, source):
    """Items with a title and factors that the user has not rated, TOP_N at most."""
    return f"""(SELECT least({TOP_N}, count(*)) FROM part WHERE p_partkey IN (SELECT item FROM things)
        AND p_partkey NOT IN (SELECT item FROM {source} WHERE "user" = {user}))"""


ORACLE.update({
    "als_explicit_holdout": _ALS + """
, s AS (SELECT 'train' AS split, "user", item FROM fitted UNION ALL
        SELECT CASE WHEN fold < 8 THEN 'validation' ELSE 'test' END AS split, "user", item FROM o WHERE fold >= 6)
SELECT split, count(*) AS n,
       count(CASE WHEN "user" IN (SELECT "user" FROM known) AND item IN (SELECT item FROM things) THEN 1 END) AS n_scored,
       CASE WHEN split = 'train' THEN true END AS beats_mean FROM s GROUP BY split""",
    "als_grid_search": """
SELECT CAST(grid_pos AS INTEGER) AS grid_pos, CAST(0.1 AS DOUBLE) AS lam, CAST(rank AS INTEGER) AS rank, CAST(7 AS INTEGER) AS iters,
       true AS finite, true AS best_is_argmin FROM (VALUES (0, 8), (1, 16)) g(grid_pos, rank)""",
    "als_validation_path": _ALS + f"""
, grid AS (
    SELECT l.i, l.lam, k.j, k.rank, t.iters
    FROM (SELECT unnest(range(5)) AS i, unnest([0.01, 0.5, 0.1, 0.2, 0.4]::DOUBLE[]) AS lam) l,
         (SELECT unnest(range(4)) AS j, unnest([2, 4, 8, 16]) AS rank) k, (SELECT unnest(range(1, 13)) AS iters) t)
SELECT CAST((i * 4 + j) * 12 + iters - 1 AS INTEGER) AS grid_pos, lam, CAST(rank AS INTEGER) AS rank, CAST(iters AS INTEGER) AS iters,
       (SELECT count(*) FROM o WHERE fold >= 6 AND fold < 8 AND "user" IN (SELECT "user" FROM known) AND item IN (SELECT item FROM things)) AS n_scored,
       true AS finite, true AS descends, CASE WHEN lam < 0.05 THEN true END AS beats_mean, true AS best_is_argmin
FROM grid""",
    "als_recommend_unseen": _ALS + f"""
SELECT {_recommended(PERSONAL_USER, 'personal')} AS n, CAST(0 AS BIGINT) AS n_seen, true AS ordered, true AS scores_match,
       {_recommended(PERSONAL_USER, 'personal')} AS n_titles""",
    "als_factors": _ALS + f"""
SELECT 'user' AS kind, "user" AS id, CAST({RANK} AS INTEGER) AS length, true AS solves FROM known
UNION ALL SELECT 'item' AS kind, item AS id, CAST({RANK} AS INTEGER) AS length, CAST(NULL AS BOOLEAN) AS solves FROM things""",
    "als_save_load": _ALS + """
SELECT "user", item, true AS same_prediction FROM o
WHERE fold >= 8 AND "user" IN (SELECT "user" FROM known) AND item IN (SELECT item FROM things)""",
    "als_implicit": _ALS + " UNION ALL ".join(f"""
SELECT CAST({u} AS INTEGER) AS "user", {_recommended(u, 'fitted')} AS n, CAST(0 AS BIGINT) AS n_seen, true AS ordered,
       true AS scores_match""" for u in IMPLICIT_USERS),
})

ORACLE.update({
    "quarantine_good": """
SELECT CAST(extract(second FROM ts) AS INTEGER) % 10 AS fold, count(*) AS n, count(DISTINCT user_id) AS users,
       CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS items
FROM events WHERE event_id % 11 NOT IN (3, 5, 7, 9) GROUP BY 1""",
    "quarantine_rejected": """
SELECT CASE event_id % 11 WHEN 3 THEN 'fields' WHEN 5 THEN 'user' WHEN 7 THEN 'rating' ELSE 'timestamp' END AS reason,
       CAST(CASE event_id % 11 WHEN 3 THEN 3 ELSE 4 END AS INTEGER) AS fields, count(*) AS n
FROM events WHERE event_id % 11 IN (3, 5, 7, 9) GROUP BY ALL""",
})

QUERIES = {
    "fold_split_counts": q_fold_split_counts,
    "quarantine_good": q_quarantine_good,
    "quarantine_rejected": q_quarantine_rejected,
    "dataset_profile": q_dataset_profile,
    "positive_ratings": q_positive_ratings,
    "train_union_personal": q_train_union_personal,
    "join_predictions_actuals": q_join_predictions_actuals,
    "rmse_predictions": q_rmse_predictions,
    "rmse_all_denominator": q_rmse_all_denominator,
    "mean_baseline_rmse": q_mean_baseline_rmse,
    "improvement_pct": q_improvement_pct,
    "parse_ratings_csv": q_parse_ratings_csv,
    "parse_ratings_double_colon": q_parse_ratings_double_colon,
    "parse_titles_csv": q_parse_titles_csv,
    "unseen_candidates": q_unseen_candidates,
    "top_n_with_titles": q_top_n_with_titles,
    "ascii_strip": q_ascii_strip,
    "best_config": q_best_config,
    "als_explicit_holdout": q_als_explicit_holdout,
    "als_grid_search": q_als_grid_search,
    "als_validation_path": q_als_validation_path,
    "als_recommend_unseen": q_als_recommend_unseen,
    "als_factors": q_als_factors,
    "als_save_load": q_als_save_load,
    "als_implicit": q_als_implicit,
}
