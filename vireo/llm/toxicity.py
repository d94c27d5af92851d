"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of the lower-cased text, present or not. Their
document counts in either class of a bounded labelled sample give a smoothed
log ratio r each; n-grams whose ratio is not significant have weight zero. A
ridge logistic regression on r times presence is fitted to the same sample,
its rows weighted to the class ratio of all labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import char_groups, labelled_sample, pick, sampled_texts, small

ORDERS = (4, 5)
BUCKETS = 1 << 20
PER_CLASS = 6_000       # labelled rows of each class in the sample
FEATURES = 4_000        # n-grams with a weight
LEAST_Z = 3.5           # significance of a log ratio, in standard errors
SMOOTH = 0.5


@dataclass
class Model:
    buckets: object      # sorted buckets with a weight
    weights: object      # classifier weight times log ratio
    intercept: float


def _hashed(codes, n):
    """Bucket of the n-gram that starts at each code point (uint32)."""
    import numpy as np

    m = len(codes) - n + 1
    h = np.full(max(m, 0), n, np.uint32)
    for i in range(n if m > 0 else 0):
        h = h * np.uint32(0x01000193) ^ codes[i:i + m]
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - (BUCKETS.bit_length() - 1))


def _present(texts, wanted=None):
    """(row, bucket) pairs, each once, of all n-grams of whole texts; ``wanted`` limits the buckets.

    ``wanted``: one flag per bucket. A text is framed by line ends, so that
    its first and last words have borders too.
    """
    import numpy as np

    edge = "\n" * (max(ORDERS) - 1)
    none = np.zeros(0, np.int64)
    for group in char_groups(texts):
        joined = edge + edge.join(t for _, t in group) + edge
        codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t.lower()) for _, t in group])
        start = np.cumsum(sizes + len(edge)) - sizes
        rows = np.array([i for i, _ in group])
        found = []
        for n in ORDERS:
            for at in range(0, len(codes), 1 << 20):       # a very long text: in parts that overlap
                h = _hashed(codes[at:at + (1 << 20) + n - 1], n)
                place = np.arange(len(h)) if wanted is None else np.flatnonzero(wanted[h])
                # an n-gram of a text starts at most one border character before it
                which = np.searchsorted(start - 1, place + at, "right") - 1
                ok = (which >= 0) & (place + at + n <= (start + sizes + 1)[np.maximum(which, 0)])
                key = (which[ok] << 20) | h[place[ok]].astype(np.int64)
                found.append(np.unique(key))
        key = np.unique(np.concatenate(found or [none]))
        yield rows[key >> 20], key & (BUCKETS - 1)


def _count(batches):
    """(label, text) -> (bucket, n0, n1): documents of either class that hold it, per task."""
    import numpy as np
    import pyarrow as pa

    total = np.zeros((2, BUCKETS), np.int32)
    for rb in batches:
        label = rb.column(0).to_numpy()
        for row, bucket in _present(rb.column(1).to_pylist()):
            for c in (0, 1):
                total[c] += np.bincount(bucket[label[row] == c], minlength=BUCKETS).astype(np.int32)
    on = np.flatnonzero(total.any(axis=0))
    for i in range(0, len(on), 1 << 16):
        part = on[i:i + (1 << 16)]
        yield pa.record_batch([pa.array(part), pa.array(total[0][part]), pa.array(total[1][part])], names=["bucket", "n0", "n1"])


def _flags(buckets):
    import numpy as np

    on = np.zeros(BUCKETS, bool)
    on[buckets] = True
    return on


def _matrix(buckets):
    """(label, weight, text) -> (label, weight, list of feature numbers)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        wanted = _flags(buckets)
        for rb in batches:
            lists = [[] for _ in range(rb.num_rows)]
            for row, bucket in _present(rb.column(2).to_pylist(), wanted):
                cuts = np.flatnonzero(np.diff(row)) + 1
                for r, b in zip(np.split(row, cuts), np.split(bucket, cuts)):
                    if len(r):
                        lists[r[0]] = np.searchsorted(buckets, b).tolist()
            yield pa.record_batch([rb.column(0), rb.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["label", "weight", "at"])

    return run


def _train(lists, y, ratio, weight, l2=1e-4, rounds=400):
    """Accelerated gradient descent for the ridge logistic loss on the scaled features."""
    import numpy as np

    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = np.array([i for x in lists for i in x], np.int64)
    value, m = ratio[at], len(ratio)
    w, b, pw, pb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    weight = weight / weight.sum()
    norm = np.bincount(rows, weights=value * value, minlength=len(y)) + 1
    rate = 4.0 / float((weight * norm).sum())       # at most the inverse curvature: the trace bounds it
    for _ in range(rounds):
        z = np.bincount(rows, weights=value * pw[at], minlength=len(y)) + pb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        nw = pw - rate * (np.bincount(at, weights=value * g[rows], minlength=m) + l2 * pw)
        nb = pb - rate * g.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", where=None, per_class: int = PER_CLASS) -> Model:
    """Model from at most ``per_class`` labelled rows of each class; ``where`` restricts the rows of ``labels``."""
    import numpy as np

    sample = labelled_sample(labels, column, per_class, where)
    texts = sampled_texts(docs, sample).select("label", "weight", "text")
    n = {r["label"]: (r["n"], r["all"]) for r in sample.groupBy("label").agg(F.count("*").alias("n"), F.max("in_class").alias("all")).collect()}
    (n0, all0), (n1, all1) = n.get(0, (0, 0)), n.get(1, (0, 0))
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((all1 + 1) / (all0 + 1))))
    counts = texts.select("label", "text").mapInArrow(_count, "bucket long, n0 int, n1 int").groupBy("bucket").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1") + SMOOTH, F.col("n0") + SMOOTH
    ratio = F.log(a / (n1 + 2 * SMOOTH)) - F.log(b / (n0 + 2 * SMOOTH))
    sure = counts.select("bucket", ratio.alias("r"), F.abs(ratio / F.sqrt(1 / a + 1 / b)).alias("z"))
    best = sure.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(FEATURES).collect()
    if not best:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((all1 + 1) / (all0 + 1))))
    best = sorted((r["bucket"], r["r"]) for r in best)
    buckets, r = np.array([x for x, _ in best]), np.array([x for _, x in best])
    rows = texts.mapInArrow(_matrix(buckets), "label int, weight double, at array<int>").collect()     # at most 2 x per_class rows
    y = np.array([x["label"] for x in rows], float)
    w, intercept = _train([x["at"] for x in rows], y, r, np.array([x["weight"] for x in rows]))
    return Model(buckets, w * r, intercept)


def score(docs: DataFrame, model: Model, keys=("doc_id",)) -> DataFrame:
    """``keys`` + score (0 to 1, higher: toxic likelier) of every whole text.

    A null text counts as empty (no n-gram of the model: the score of the
    intercept); repeated rows come back repeated; an empty table gives an
    empty result; without labels of both classes the score is their smoothed share.
    """
    rows = pick(docs, *keys, "text")
    kinds = dict(rows.dtypes)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        wanted = _flags(model.buckets)
        for rb in small(batches):
            at = rb.num_columns - 1
            z = np.full(rb.num_rows, model.intercept)
            if len(model.buckets):
                for row, bucket in _present([t or "" for t in rb.column(at).to_pylist()], wanted):
                    np.add.at(z, row, model.weights[np.searchsorted(model.buckets, bucket)])
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch([*rb.columns[:at], pa.array(s)], names=[*rb.schema.names[:at], "score"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", score double")
