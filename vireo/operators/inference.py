"""Batched model scoring: logits -> softmax -> top-k labels with a name lookup.

The model is a weight matrix (classes x features). It is fitted with a
distributed aggregate, collected as one row per class, then shipped to the
executors (as one array constant for the expression path, as a broadcast variable for
the Arrow path), like the reference shipped its model bytes with
``sc.broadcast``: a model has to fit a worker, whatever the data's size.

* ``method="expr"``: pure Spark expressions, per-row top-k by sorting an array
  of (score, class) structs: no shuffle at all.
* ``method="batches"``: ``mapInArrow`` with numpy matrix products per batch
  (the path for large models or foreign runtimes).
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, dot
from .neighbors import rejected, usable


def fit_centroids(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Per-class mean vector (label, pos, w) as one distributed aggregate."""
    return df.select(F.col(label).alias("label"), F.posexplode(as_double(vec)).alias("pos", "x")) \
        .groupBy("label", "pos").agg(F.avg("x").alias("w"))


def collect_model(weights: DataFrame) -> tuple[list[int], np.ndarray]:
    """(label, pos, w) rows -> (class ids, dense matrix): one row of weights per class reaches the driver."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"])
    rows = weights.groupBy("label").agg(row.alias("w")).orderBy("label").collect()
    return [int(r["label"]) for r in rows], np.array([r["w"] for r in rows], dtype=np.float64)


def logits_expr(vec: str | Column, w: np.ndarray, temperature: float = 1.0) -> Column:
    """Array of per-class logits ``temperature * x . w_c`` as Spark expressions. The finite
    weights are one constant that the optimizer folds, not an expression per weight."""
    model = F.from_json(F.lit(json.dumps(np.asarray(w, dtype=np.float64).tolist(), allow_nan=False)), "array<array<double>>")
    return F.transform(model, lambda row: dot(vec, row) * F.lit(float(temperature)))


def predict_class(vec: str | Column, classes: list[int], w: np.ndarray) -> Column:
    """Class id with the highest logit (first on ties)."""
    # a one-element array binds the logits, so that they are computed once per row
    first = lambda lg: F.array_position(lg, F.array_max(lg))
    pos = F.element_at(F.transform(F.array(logits_expr(vec, w)), first), 1)
    return F.element_at(F.array(*[F.lit(c) for c in classes]), pos.cast("int"))


def error_rate(df: DataFrame, pred: str, label: str) -> DataFrame:
    """100 - 100 * share of rows with pred == label."""
    return df.agg((F.lit(100.0) - F.lit(100.0) * F.avg((F.col(pred) == F.col(label)).cast("double")))
                  .alias("error_rate"))


def with_probabilities(df: DataFrame, vec: str, w: np.ndarray, temperature: float = 1.0,
                       out: str = "probs") -> DataFrame:
    """Add the softmax class probabilities. Each intermediate array is its own
    projected column so it is computed once per row (inside a lambda a shared
    sub-expression would be re-evaluated for every element)."""
    return (df.withColumn("_lg", logits_expr(vec, w, temperature))
              .withColumn("_mx", F.array_max("_lg"))
              .withColumn("_ex", F.transform("_lg", lambda x: F.exp(x - F.col("_mx"))))
              .withColumn("_tot", F.aggregate("_ex", F.lit(0.0), lambda a, x: a + x))
              .withColumn(out, F.transform("_ex", lambda x: x / F.col("_tot")))
              .drop("_lg", "_mx", "_ex", "_tot"))


def score_top_k(df: DataFrame, key: str, vec: str, classes: list[int], w: np.ndarray, k: int = 5,
                temperature: float = 1.0, names: DataFrame | None = None, default_name: str = "",
                method: str = "batches") -> DataFrame:
    """(key, rank, label, score[, name]) of the ``k`` most probable classes per row
    (ties by class id); no shuffle. ``method="batches"`` scores Arrow batches with
    numpy (fast: one matrix product per batch); ``method="expr"`` uses Spark
    higher-order functions (no Python, but interpreted per element). Names come
    from a joined lookup table, unknown ids get ``default_name``. Rows without a
    usable vector are left out; :func:`rejected_rows` lists them."""
    df = df.where(usable(df, vec, int(w.shape[1])))
    if method == "batches":
        out = score_top_k_batches(df, key, vec, classes, w, k, temperature)
    elif method == "expr":
        out = _score_top_k_expr(df, key, vec, classes, w, k, temperature)
    else:
        raise ValueError(f"unknown method {method!r}")
    if names is not None:
        out = out.join(names.select("label", "name"), "label", "left") \
            .withColumn("name", F.coalesce(F.col("name"), F.lit(default_name)))
    return out


def _score_top_k_expr(df: DataFrame, key: str, vec: str, classes: list[int], w: np.ndarray, k: int,
                      temperature: float) -> DataFrame:
    cls = F.array(*[F.lit(c) for c in classes])
    p = with_probabilities(df.select(key, vec), vec, w, temperature)
    pairs = F.transform(F.arrays_zip(F.col("probs").alias("p"), cls.alias("c")),
                        lambda z: F.struct((-z["p"]).alias("neg"), z["c"].alias("label")))
    return p.select(F.col(key), F.posexplode(F.slice(F.sort_array(pairs), 1, k)).alias("pos", "t")) \
        .select(key, (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.label").alias("label"),
                (-F.col("t.neg")).alias("score"))


def rejected_rows(df: DataFrame, key: str, vec: str, w: np.ndarray) -> DataFrame:
    """(key, reason) of the rows that scoring leaves out."""
    return rejected(df, key, vec, int(w.shape[1]))


def score_top_k_batches(df: DataFrame, key: str, vec: str, classes: list[int], w: np.ndarray,
                        k: int = 5, temperature: float = 1.0) -> DataFrame:
    """Arrow-batch scorer: numpy logits, softmax and top-k of whole batches, the
    model in a broadcast variable. ``df`` holds usable vectors only."""
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(classes), np.asarray(w, dtype=np.float64)))
    kt = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        cl, wm = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, wm.shape[1]).astype(np.float64)
            lg = temperature * (x @ wm.T)
            lg -= lg.max(axis=1, keepdims=True)
            p = np.exp(lg)
            p /= p.sum(axis=1, keepdims=True)
            kk = min(k, p.shape[1])
            order = np.lexsort((np.broadcast_to(np.arange(p.shape[1]), p.shape), -p), axis=1)[:, :kk].reshape(-1)
            rows = np.repeat(np.arange(p.shape[0]), kk)
            yield pa.record_batch([b.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, kk + 1), p.shape[0]).astype(np.int32)),
                                   pa.array(cl[order].astype(np.int32)), pa.array(p[rows, order])], names=[key, "rank", "label", "score"])

    return df.select(key, vec).mapInArrow(run, f"{key} {kt}, rank int, label int, score double")
