"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, found by position, so that other columns whose
    names differ only in case cannot make a reference ambiguous."""
    cols = df.columns
    pos = df.toDF(*[f"c{i}" for i in range(len(cols))])
    return pos.select(*[F.col(f"c{cols.index(n)}").alias(n) for n in names])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``key``, a hash of both, which tells rows with the same id apart."""
    return pick(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder of ``spark.checkpoint.dir`` and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_rows(docs: DataFrame, kept: DataFrame, once: bool) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, row key) is in ``kept`` (columns ``doc_id``, ``key``).

    With ``once`` only one of several identical rows stays. Every column of
    ``docs`` comes back as it was.
    """
    cols = docs.columns
    pos = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    i, t = (F.col(f"c{cols.index(c)}") for c in ("doc_id", "text"))
    left = pos.withColumn("_key", F.xxhash64(i, t)).withColumn("_id", i)
    right = kept.select(F.col("doc_id").alias("_kid"), F.col("key").alias("_kkey")).distinct()
    out = left.join(right, F.col("_key").eqNullSafe(F.col("_kkey")) & F.col("_id").eqNullSafe(F.col("_kid")), "left_semi")
    if once:
        # rows that repeat share id, key and text; all others are alone in their group
        w = Window.partitionBy("_key", "_id").orderBy("_key")
        out = out.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return out.select(*[f"c{k}" for k in range(len(cols))]).toDF(*cols)


def pow2_at_least(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def crc_mod(m: int, col: str = "doc_id"):
    """crc32 of the id as text, modulo ``m``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def labelled_sample(labels: DataFrame, column: str, per_class: int, where=None) -> DataFrame:
    """A bounded training sample: for either class at most ``per_class`` ids, those of the
    least hash, as a local table (doc_id, label, half 0/1, weight, in_class).

    ``in_class`` counts the permitted ids of the row's class, ``weight`` is that over the sampled
    ones: weighted, the sample has the class ratio of all labels, whether or not a class is cut.
    Null ids and labels are left out; an id that is labelled twice counts once, with the larger label.
    """
    rows = pick(labels, "doc_id", column).withColumnRenamed(column, "label")
    if where is not None:
        rows = rows.where(where)
    rows = rows.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    n_all = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    found = []
    for c in (0, 1):
        best = rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
        found += [(r["doc_id"], c, n % 2, n_all[c] / len(best), n_all[c]) for n, r in enumerate(best)]
    return labels.sparkSession.createDataFrame(found, "doc_id long, label int, half int, weight double, in_class long")


def least_hashes(rows: DataFrame, group: str, limit: int, salts: int = 64) -> DataFrame:
    """The ``limit`` rows of each group whose doc_id has the least hash; a large group is cut down in ``salts`` parts first."""
    at = F.xxhash64("doc_id")
    for by in ([group, F.pmod(at, F.lit(salts))], [group]):
        w = Window.partitionBy(*by).orderBy(at, "doc_id")
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    return rows


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``sample`` with the whole text of its rows; the texts are not shuffled."""
    texts = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return texts.join(F.broadcast(sample), "doc_id")        # at most the sample's bounded number of ids


def kept(key, make):
    """``make()``, once for a worker process: tasks get this package's code by value, so its module variables do not last."""
    import sys

    state = sys.__dict__.setdefault("_vireo_kept", {})
    if key not in state:
        state[key] = make()
    return state[key]


def small(batches, rows: int = 512):
    """The batches in slices of at most ``rows`` rows: bounds the texts that a task has unpacked at once."""
    for rb in batches:
        for at in range(0, rb.num_rows, rows):
            yield rb.slice(at, rows)


def char_groups(texts, most: int = 1 << 20):
    """Lists of (row, text part) of about ``most`` characters in all; a longer text is a group of its own."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append((i, t))
        size += len(t)
    if group:
        yield group


def fit_logistic(x, y, weight=None, l2=1e-3, rounds=60):
    """Newton steps for a ridge logistic regression on a few standardised features.

    Returns (mean, scale, weights with the intercept last).
    """
    import numpy as np

    weight = np.ones(len(y)) if weight is None else weight
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = l2 * np.r_[np.ones(len(w) - 1), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) / weight.sum() + ridge * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w
