"""Rating splits, error metrics, baselines and ALS training / recommendation.

Folds come from the data (``fold`` in 0..9): train < 6, validation 6..7,
test >= 8. Every metric is one grouped aggregate; scalars that feed another
expression (a global mean) travel as lazy scalar subqueries, never through the
driver and never by a cross join.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

SPLITS = ("train", "validation", "test")


def split_label(fold: Column | str = "fold") -> Column:
    f = F.col(fold) if isinstance(fold, str) else fold
    return F.when(f < 6, F.lit("train")).when(f < 8, F.lit("validation")).otherwise(F.lit("test"))


def split(ratings: DataFrame, which: str, fold: str = "fold") -> DataFrame:
    f = F.col(fold)
    cond = {"train": f < 6, "validation": (f >= 6) & (f < 8), "test": f >= 8}[which]
    return ratings.filter(cond)


def fold_split_counts(ratings: DataFrame, fold: str = "fold") -> DataFrame:
    return ratings.groupBy(split_label(fold).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def dataset_profile(ratings: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """Ratings, distinct users and distinct items (exact) in one pass."""
    return ratings.agg(F.count(F.lit(1)).alias("n_ratings"),
                       F.count_distinct(user).alias("n_users"),
                       F.count_distinct(item).alias("n_items"))


def with_personal(train: DataFrame, personal: DataFrame, cols=("user", "item", "rating")) -> DataFrame:
    """Bag union of the training fold and a user's own ratings (UNION ALL)."""
    return train.select(*cols).unionByName(personal.select(*cols))


def user_mean_predictor(train: DataFrame, user: str = "user", rating: str = "rating") -> DataFrame:
    """Deterministic reference predictor: a user's mean training rating."""
    return train.groupBy(user).agg(F.avg(rating).alias("prediction"))


def item_mean_predictor(train: DataFrame, item: str = "item", rating: str = "rating") -> DataFrame:
    return train.groupBy(item).agg(F.avg(rating).alias("prediction"))


def predict_pairs(model: DataFrame, pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Score distinct (user, item) pairs with a keyed predictor table."""
    return pairs.select("user", "item").distinct().join(model, list(key), "inner")


def join_predictions(predictions: DataFrame, actuals: DataFrame,
                     on: Sequence[str] = ("user", "item")) -> DataFrame:
    """predictions (user, item, prediction) inner-join actuals (user, item, rating):
    duplicate pairs multiply, unscored pairs vanish."""
    return predictions.join(actuals, list(on), "inner")


def rmse(actuals: DataFrame, predictions: DataFrame | None = None,
         on: Sequence[str] = ("user", "item"), pred: str = "prediction",
         label: str = "rating") -> DataFrame:
    """One row: ``rmse`` over scored rows, ``rmse_all`` dividing by every actual
    row (the reference's denominator: optimistic when rows are unscored),
    ``n_scored`` and ``n``.

    With ``predictions`` given, they are left-joined to ``actuals`` on ``on``;
    otherwise ``actuals`` must already hold ``pred``.
    """
    df = actuals if predictions is None else actuals.join(predictions, list(on), "left")
    sq = F.pow(F.col(pred) - F.col(label), 2)
    return df.agg(F.sum(sq).alias("_ss"), F.count(F.col(pred)).alias("n_scored"),
                  F.count(F.lit(1)).alias("n")) \
        .select(F.sqrt(F.try_divide(F.col("_ss"), F.col("n_scored"))).alias("rmse"),
                F.sqrt(F.try_divide(F.coalesce(F.col("_ss"), F.lit(0.0)), F.col("n"))).alias("rmse_all"),
                "n_scored", "n")


def mean_baseline_rmse(train_val: DataFrame, test: DataFrame, rating: str = "rating") -> DataFrame:
    """Global mean over train + validation; RMSE of always predicting it on test."""
    mu = train_val.select(F.avg(rating)).scalar()
    return test.agg(F.sqrt(F.avg(F.pow(mu - F.col(rating), 2))).alias("baseline_rmse"),
                    F.first(mu).alias("mean_rating")).select("mean_rating", "baseline_rmse")


def improvement(train_val: DataFrame, test: DataFrame, predictions: DataFrame,
                on: Sequence[str] = ("user",), rating: str = "rating") -> DataFrame:
    """(baseline - model) / baseline * 100 with the reference's RMSE denominator."""
    mu = train_val.select(F.avg(rating)).scalar()
    j = test.join(predictions, list(on), "left")
    g = j.agg(F.sum(F.pow(F.col("prediction") - F.col(rating), 2)).alias("ss"),
              F.sum(F.pow(mu - F.col(rating), 2)).alias("bs"),
              F.count(F.lit(1)).alias("n"))
    return g.select(
        F.sqrt(F.col("ss") / F.col("n")).alias("model_rmse"),
        F.sqrt(F.col("bs") / F.col("n")).alias("baseline_rmse"),
    ).withColumn("improvement_pct",
                 (F.col("baseline_rmse") - F.col("model_rmse")) / F.col("baseline_rmse") * 100)


def damped_item_mean_grid(train: DataFrame, valid: DataFrame, lambdas: Sequence[float],
                          item: str = "item", rating: str = "rating") -> DataFrame:
    """Grid search over the shrinkage of a damped item-mean predictor
    ``mu + sum(r - mu) / (n_i + lambda)``: validation RMSE for every grid point in
    one aggregate, and the argmin (first grid position wins ties).
    """
    mu = train.select(F.avg(rating)).scalar()
    stats = train.groupBy(item).agg(F.sum(F.col(rating) - mu).alias("dev"), F.count(F.lit(1)).alias("cnt"))
    lams = [float(x) for x in lambdas]

    def error(lam):
        return F.sqrt(F.avg(F.pow(mu + F.coalesce(F.col("dev") / (F.col("cnt") + lam), F.lit(0.0)) - F.col(rating), 2)))

    # one conditional aggregate per grid point over the rows as they are, then one row per point
    wide = valid.join(stats, item, "left").agg(*[error(x).alias(f"e{i}") for i, x in enumerate(lams)])
    point = [F.struct(F.lit(i).alias("grid_pos"), F.lit(x).alias("lam"), F.col(f"e{i}").alias("val_rmse")) for i, x in enumerate(lams)]
    res = wide.select(F.inline(F.array(*point)))
    best = res.select(F.min_by("grid_pos", F.struct("val_rmse", "grid_pos")).alias("b")).scalar()
    return res.withColumn("is_best", F.col("grid_pos") == best)


# ---------------------------------------------------------------- ALS ----

def dense_ids(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Mapping (col, out) of every distinct value of ``col`` to 0..n-1 in value
    order; distributed numbering (no single-partition window)."""
    from .relational import global_rank

    return global_rank(df.select(col).distinct(), [col], pos_col=out) \
        .select(col, (F.col(out) - 1).cast("int").alias(out))


def train_als(train: DataFrame, rank: int = 16, max_iter: int = 7, reg: float = 0.1,
              implicit: bool = False, alpha: float = 1.0, seed: int = 42,
              user: str = "user", item: str = "item", rating: str = "rating",
              num_blocks: int | None = None, checkpoint_interval: int = 10):
    """Fit ``pyspark.ml`` ALS; ids must fit in int (a larger one raises: see :func:`train_als_any_ids`). Factor blocks are exchanged
    between executors each half-iteration; lineage is cut every
    ``checkpoint_interval`` iterations in the shared checkpoint folder."""
    from pyspark.ml.recommendation import ALS

    from ..session import ensure_checkpoint_dir

    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    blocks = num_blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, implicitPrefs=implicit, alpha=alpha,
              userCol=user, itemCol=item, ratingCol=rating, seed=seed,
              coldStartStrategy="drop", numUserBlocks=blocks, numItemBlocks=blocks,
              checkpointInterval=checkpoint_interval)
    data = train.select(F.col(user).cast("int").alias(user), F.col(item).cast("int").alias(item),
                        F.col(rating).cast("float").alias(rating))
    return als.fit(data)


class IndexedALSModel:
    """An ALS model fitted on dense int ids, with the (key, idx) tables that map
    wide (e.g. 64-bit) user and item keys in and out by joins."""

    def __init__(self, model, users: DataFrame, items: DataFrame, user: str = "user", item: str = "item"):
        self.model, self.users, self.items, self.user, self.item = model, users, items, user, item

    def transform(self, pairs: DataFrame) -> DataFrame:
        u, i = self.user, self.item
        x = pairs.join(self.users.withColumnRenamed("idx", "_u"), u, "inner") \
            .join(self.items.withColumnRenamed("idx", "_i"), i, "inner")
        scored = self.model.transform(
            x.withColumnRenamed(u, "_key_u").withColumnRenamed(i, "_key_i")
             .withColumnRenamed("_u", u).withColumnRenamed("_i", i))
        return scored.drop(u, i).withColumnRenamed("_key_u", u).withColumnRenamed("_key_i", i)


def train_als_any_ids(train: DataFrame, user: str = "user", item: str = "item", **kw):
    """ALS for keys of any integral width: they are mapped to dense ids
    (distributed numbering of the distinct keys) and the returned model maps them
    back when scoring. More than 2^31 distinct users or items raise."""
    users, items = dense_ids(train, user), dense_ids(train, item)
    x = train.join(users, user).drop(user).withColumnRenamed("idx", user) \
        .join(items, item).drop(item).withColumnRenamed("idx", item)
    return IndexedALSModel(train_als(x, user=user, item=item, **kw), users, items, user, item)


def als_predict(model, pairs: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """Score (user, item) rows; cold users/items are dropped."""
    if isinstance(model, IndexedALSModel):
        return model.transform(pairs)
    data = pairs.withColumn(user, F.col(user).cast("int")).withColumn(item, F.col(item).cast("int"))
    return model.transform(data)


def als_rmse(model, data: DataFrame, rating: str = "rating") -> DataFrame:
    scored = als_predict(model, data).withColumn("prediction", F.col("prediction").cast("double"))
    n = data.select(F.count(F.lit(1))).scalar()
    return scored.agg(F.sqrt(F.sum(F.pow(F.col("prediction") - F.col(rating), 2)) / n).alias("rmse_all"),
                      F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(rating), 2))).alias("rmse"),
                      F.count(F.lit(1)).alias("n_scored"))


def als_split_rmse(model, data: DataFrame, split_col: str = "split", rating: str = "rating") -> DataFrame:
    """RMSE of every split in one pass: (split, n, n_scored, rmse, rmse_all). ``data``: user, item, rating, split."""
    sq = F.pow(F.col("prediction").cast("double") - F.col(rating), 2)
    scored = als_predict(model, data).groupBy(split_col).agg(F.sum(sq).alias("ss"), F.count(F.lit(1)).alias("n_scored"))
    total = data.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    return total.join(scored, split_col, "left").select(
        split_col, "n", F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
        F.sqrt(F.try_divide("ss", "n_scored")).alias("rmse"), F.sqrt(F.coalesce("ss", F.lit(0.0)) / F.col("n")).alias("rmse_all"))


def normal_equation_gap(model, train: DataFrame, reg: float, user: str = "user", item: str = "item", rating: str = "rating") -> DataFrame:
    """(user, gap): how far each user's factors are from solving their regularised
    least squares given the item factors, relative to the size of its right side.
    The user step is the last of an explicit fit, so the gap is rounding only."""
    rank = model.rank
    rows = train.select(F.col(user).alias("_u"), F.col(item).alias("_i"), F.col(rating).alias("_r")) \
        .join(model.userFactors.select(F.col("id").alias("_u"), F.col("features").alias("_x")), "_u") \
        .join(model.itemFactors.select(F.col("id").alias("_i"), F.col("features").alias("_y")), "_i")
    part = lambda c, j: F.element_at(c, j + 1).cast("double")
    error = sum((part("_x", j) * part("_y", j) for j in range(rank)), F.lit(0.0)) - F.col("_r")
    sums = [F.sum(F.col("_e") * part("_y", j) + reg * part("_x", j)).alias(f"g{j}") for j in range(rank)]
    size = [F.sum(F.abs(F.col("_r") * part("_y", j))).alias(f"b{j}") for j in range(rank)]
    agg = rows.withColumn("_e", error).groupBy("_u").agg(*sums, *size)
    gap = F.greatest(*[F.abs(f"g{j}") for j in range(rank)]) / (F.greatest(*[F.col(f"b{j}") for j in range(rank)]) + F.lit(1e-6))
    return agg.select(F.col("_u").alias(user), gap.alias("gap"))


def als_grid_search(train: DataFrame, valid: DataFrame, ranks: Sequence[int] = (16,),
                    lambdas: Sequence[float] = (0.1,), iters: Sequence[int] = (7,),
                    seed: int = 42, parallelism: int = 1):
    """Fit every (lambda, rank, iterations) point; keep the lowest validation RMSE
    (strict ``<``: the first grid point wins ties). Returns (rows, best_model).

    The grid is a handful of parameter tuples iterated on the driver; each fit
    is a distributed job (``parallelism`` fits run concurrently).
    """
    train = train.cache()
    valid = valid.cache()
    grid = list(itertools.product(lambdas, ranks, iters))

    def fit(args):
        pos, (lam, rank, it) = args
        m = train_als(train, rank=rank, max_iter=it, reg=lam, seed=seed)
        v = als_rmse(m, valid).first()
        t = als_rmse(m, train).first()
        return pos, lam, rank, it, m, v["rmse_all"], t["rmse_all"]

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            results = list(ex.map(fit, enumerate(grid)))
    finally:
        train.unpersist()
        valid.unpersist()
    best = None
    for r in results:
        if best is None or r[5] < best[5]:
            best = r
    rows = [(r[0], float(r[1]), int(r[2]), int(r[3]), float(r[6]), float(r[5]), r is best) for r in results]
    return rows, best[4]


def recommend_unseen(model, items: DataFrame, rated: DataFrame, user_id: int, n: int = 50,
                     item: str = "item") -> DataFrame:
    """Top-``n`` items the user has not rated, by predicted score (ties by item).

    The user's factor vector enters as a lazy scalar subquery and candidates
    are equi-joined to the item factors, so the plan has no nested-loop join
    (scoring through ``transform`` with a constant user id would compare every
    candidate with every user factor). Items without factors are dropped.
    """
    from ..functions.vectors import dot

    cand = items.select(item).distinct().join(rated.filter(F.col("user") == user_id).select(item).distinct(),
                                              item, "left_anti")
    if isinstance(model, IndexedALSModel):
        # wide keys: user vector and item factors reached through the id tables
        uvec = model.model.userFactors.join(model.users.filter(F.col(model.user) == user_id),
                                            F.col("id") == F.col("idx")).select("features").scalar()
        factors = model.model.itemFactors.join(model.items, F.col("id") == F.col("idx")) \
            .select(F.col(model.item).alias("_fid"), F.col("features").alias("_f"))
        on = F.col(item) == F.col("_fid")
    else:
        uvec = model.userFactors.filter(F.col("id") == int(user_id)).select("features").scalar()
        factors = model.itemFactors.select(F.col("id").alias("_fid"), F.col("features").alias("_f"))
        on = F.col(item).cast("int") == F.col("_fid")
    scored = cand.join(factors, on, "inner") \
        .withColumn("_u", uvec) \
        .select(F.lit(user_id).alias("user"), F.col(item),
                dot(F.col("_f"), F.col("_u")).cast("float").alias("prediction")) \
        .filter(F.col("prediction").isNotNull())
    return scored.orderBy(F.col("prediction").desc(), F.col(item)).limit(n)


def recommend_users_unseen(model, items: DataFrame, rated: DataFrame, users: Sequence[int], n: int = 50) -> DataFrame:
    """Top-``n`` unseen items of each named user (:func:`recommend_unseen` for each, in one union)."""
    out = [recommend_unseen(model, items, rated, u, n) for u in users]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def recommend_all_unseen(model, rated: DataFrame, n: int = 10, first_k: int | None = None) -> DataFrame:
    """Exact top-``n`` unseen items of every user, (user, item, prediction, rank).

    Round 1 asks every user for ``first_k`` (default ``2 n``) best items with
    ``recommendForUserSubset`` (blocked factor products with per-user heaps, no
    user x item table) and drops rated pairs. A user with fewer than ``n``
    unseen items left, and more items to look at, goes to the next round with
    twice the k; so a user who rated a large share of the catalogue costs more
    only for that user. Each round's pending set is small and checkpointed.
    """
    from ..session import ensure_checkpoint_dir
    from .relational import top_k_per_group

    if isinstance(model, IndexedALSModel):
        # wide keys: run on dense ids, map the result back through the id tables
        u, i = model.user, model.item
        dense = rated.join(model.users, u).drop(u).withColumnRenamed("idx", "user") \
            .join(model.items, i).drop(i).withColumnRenamed("idx", "item")
        out = recommend_all_unseen(model.model, dense, n, first_k) \
            .withColumnRenamed("user", "_du").withColumnRenamed("item", "_di")
        users = model.users.select(F.col(u).alias("_ku"), F.col("idx").alias("_du"))
        items = model.items.select(F.col(i).alias("_ki"), F.col("idx").alias("_di"))
        return out.join(users, "_du").join(items, "_di") \
            .select(F.col("_ku").alias("user"), F.col("_ki").alias("item"), "prediction", "rank")
    ensure_checkpoint_dir(rated.sparkSession)
    pairs = rated.select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item")) \
        .distinct()
    n_items = model.itemFactors.count()
    pending = model.userFactors.select(F.col("id").alias("user"))
    k = max(n, first_k or 2 * n)
    parts = []
    while True:                       # k doubles up to the number of items: every user is done by then
        kk = min(k, n_items)
        recs = model.recommendForUserSubset(pending, kk) \
            .select("user", F.explode("recommendations").alias("r")) \
            .select("user", F.col("r.item").alias("item"), F.col("r.rating").cast("double").alias("prediction"))
        unseen = recs.join(pairs, ["user", "item"], "left_anti")
        top = top_k_per_group(unseen, ["user"], [F.col("prediction").desc(), F.col("item")], n).checkpoint()
        if kk >= n_items:
            parts.append(top)
            break
        done = top.groupBy("user").count().filter(F.col("count") >= n).select("user")
        parts.append(top.join(done, "user", "left_semi"))
        pending = pending.join(done, "user", "left_anti").checkpoint()
        if pending.isEmpty():
            break
        k *= 2
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def recommend_by_norm(model, users: DataFrame, rated: DataFrame, n: int = 10, block_size: int = 2048) -> DataFrame:
    """Exact top-``n`` unseen items (user, rank, item, score) of the ``users`` (column ``user``) that the model knows.

    Items come in blocks of falling factor norm, and a user leaves as soon as no later item can be
    among its best (:func:`search.best_products`): nobody is asked again for a longer list.
    """
    from .search import best_products

    wanted = users.select(F.col("user").cast("int").alias("user")).distinct()
    u = model.userFactors.select(F.col("id").alias("user"), F.col("features").alias("v")).join(wanted, "user")
    i = model.itemFactors.select(F.col("id").alias("item"), F.col("features").alias("v"))
    seen = rated.select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item")).join(wanted, "user")
    return best_products(u, i, seen, n, block_size)


def save_and_load(model):
    """Save the model below the shared checkpoint folder and load it back."""
    from pyspark.ml.recommendation import ALSModel

    path = shared_path(model.userFactors.sparkSession, "als-model")
    model.write().overwrite().save(path)
    return ALSModel.load(path)
