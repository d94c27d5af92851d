"""Hyper-parameter sweep: a grid of configurations, all fitted in the same passes.

The reference trained one single-machine network per task on broadcast data.
Here the training set stays partitioned and every step of gradient descent is
one pass over it: a task adds up the partial gradients of *all* configurations
(networks with one hidden layer of ``fc1_size`` sigmoid units and a softmax),
the sums meet in a tree, and the driver, which holds the weights alone, takes
the step. The step is the base learning rate (times a constant, since a step
here averages over all rows) and decays from epoch to epoch. What travels per
task and step is the size of the grid's weights, whatever the data's size.
A fit that diverges, its loss no longer finite, keeps the reference's sentinel
(loss and errors 100.0) and takes no further part; any error is raised.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the reference grid: 10 learning rates logspace(-3, -1), one
# decay rate 0.95, hidden sizes 64, 128, 256, 512, 1024.
LEARNING_RATES = tuple(float(x) for x in np.logspace(-3, -1, num=10, base=10.0))
DECAY_RATES = (0.95,)
FC1_SIZES = (64, 128, 256, 512, 1024)
SENTINEL = 100.0
STEP = 30.0             # full-batch step of learning rate 1
BLOCK = 256             # rows of one matrix product

RESULT_SCHEMA = ("grid_pos int, base_learning_rate double, decay_rate double, fc1_size int, "
                 "minibatch_loss double, validation_error double, test_error double")


def param_grid(spark: SparkSession, rates: Sequence[float] = LEARNING_RATES,
               decays: Sequence[float] = DECAY_RATES, sizes: Sequence[int] = FC1_SIZES) -> DataFrame:
    """Cross product of the three axes (rates outermost), with its grid position."""
    rows = [(i, float(r), float(d), int(s)) for i, (r, d, s) in
            enumerate(itertools.product(rates, decays, sizes))]
    return spark.createDataFrame(rows, "grid_pos int, base_learning_rate double, decay_rate double, fc1_size int")


def _blocks(df: DataFrame, vec: str, label: str, n_classes: int) -> DataFrame:
    """Rows -> blocks (n, x, y) of at most ``BLOCK`` rows, vectors as float64 bytes, labels as int64 bytes.
    A missing vector or a label outside 0 .. n_classes - 1 is an error."""

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            for at in range(0, rb.num_rows, BLOCK):
                part = rb.slice(at, BLOCK)
                x, y = part.column(0).flatten(), part.column(1)
                if part.column(0).null_count or x.null_count or y.null_count:
                    raise ValueError("sweep: a vector, an element or a label is missing")
                y = y.to_numpy(zero_copy_only=False)
                if y.min() < 0 or y.max() >= n_classes:
                    raise ValueError("sweep: a label is no class")
                yield pa.record_batch([pa.array([part.num_rows], pa.int64()), pa.array([x.to_numpy(zero_copy_only=False).tobytes()]),
                                       pa.array([y.tobytes()])], names=["n", "x", "y"])

    return df.select(F.col(vec).cast("array<double>"), F.col(label).cast("long")).mapInArrow(run, "n long, x binary, y binary")


def _forward(net, x):
    """Hidden units and class probabilities of a block."""
    w1, b1, w2, b2 = net
    h = 1 / (1 + np.exp(-np.clip(x @ w1 + b1, -500, 500)))
    z = h @ w2 + b2
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return h, p / p.sum(axis=1, keepdims=True)


def _gradient(net, x, y):
    """[loss, gradients..] of a network, summed over a block."""
    h, p = _forward(net, x)
    at = np.arange(len(y))
    with np.errstate(divide="ignore"):
        loss = -np.log(p[at, y]).sum()
    p[at, y] -= 1
    back = (p @ net[2].T) * h * (1 - h)
    return [loss, x.T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0)]


def _wrong(net, x, y):
    """[rows of a block whose likeliest class is another]; the first class wins ties."""
    return [float((_forward(net, x)[1].argmax(axis=1) != y).sum())]


def _totals(blocks: DataFrame, nets: dict, measure) -> tuple[int, dict]:
    """Rows in all, and for every network the sums of ``measure`` over all blocks: one pass, summed as a tree."""
    shared = blocks.sparkSession.sparkContext.broadcast(nets)

    def add(total, block):
        y = np.frombuffer(block["y"], np.int64)
        x = np.frombuffer(block["x"], np.float64).reshape(len(y), -1)
        with np.errstate(over="ignore", invalid="ignore"):
            return both(total, (len(y), {k: measure(net, x, y) for k, net in shared.value.items()}))

    def both(a, b):
        if not a[0] or not b[0]:
            return a if a[0] else b
        for k, sums in a[1].items():
            for i, more in enumerate(b[1][k]):
                sums[i] += more                     # in place: both are this task's own
        return a[0] + b[0], a[1]

    try:
        return blocks.rdd.treeAggregate((0, {}), add, both, depth=2)
    finally:
        shared.unpersist()


def _start(rng, dim: int, size: int, n_classes: int):
    """Weights drawn evenly within sqrt(6 / (inputs + outputs)) of zero."""
    draw = lambda n, m: rng.uniform(-1, 1, (n, m)) * np.sqrt(6 / (n + m))
    return [draw(dim, size), np.zeros(size), draw(size, n_classes), np.zeros(n_classes)]


def sweep(train: DataFrame, valid: DataFrame, test: DataFrame, vec: str, label: str,
          n_classes: int, rates: Sequence[float] = LEARNING_RATES,
          decays: Sequence[float] = DECAY_RATES, sizes: Sequence[int] = FC1_SIZES,
          epochs: int = 2, max_iter: int = 10, seed: int = 7) -> DataFrame:
    """One result row per configuration (see ``RESULT_SCHEMA``).

    Epoch e takes ``max_iter`` steps of ``STEP * rate * decay ** e``, each one pass over ``train`` for the
    whole grid; ``minibatch_loss`` is the mean loss that the last of them saw. Networks of one size start
    from the same weights.
    """
    spark = train.sparkSession
    grid = list(itertools.product(rates, decays, sizes))
    blocks, cores = _blocks(train, vec, label, n_classes), spark.sparkContext.defaultParallelism
    if blocks.rdd.getNumPartitions() < cores:
        blocks = blocks.repartition(cores)          # few input files: a step is work for all cores
    blocks = blocks.persist()                       # read once per step; recomputed where lost
    try:
        first = blocks.first()
        if first is None:
            raise ValueError("sweep: no training rows")
        dim = len(first["x"]) // 8 // first["n"]
        nets = {k: _start(np.random.default_rng([seed, int(size)]), dim, int(size), n_classes) for k, (_, _, size) in enumerate(grid)}
        loss = {}
        for epoch in range(epochs):
            for _ in range(max_iter):
                n, sums = _totals(blocks, nets, _gradient)
                loss = {k: float(v[0]) / n for k, v in sums.items()}
                nets = {k: [w - STEP * float(grid[k][0]) * float(grid[k][1]) ** epoch / n * g for w, g in zip(nets[k], sums[k][1:])]
                        for k in nets if np.isfinite(loss[k])}
        errors = []
        for part in (valid, test):
            n, sums = _totals(_blocks(part, vec, label, n_classes), nets, _wrong)
            errors.append({k: SENTINEL * v[0] / n for k, v in sums.items()} if n else {})
    finally:
        blocks.unpersist()
    rows = [(k, float(lr), float(decay), int(size), loss[k] if k in nets else SENTINEL, *(e.get(k, SENTINEL) for e in errors))
            for k, (lr, decay, size) in enumerate(grid)]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def best_config(results: DataFrame, metric: str = "validation_error") -> DataFrame:
    """Lowest ``metric``; the first grid position wins ties."""
    return results.orderBy(F.col(metric), F.col("grid_pos")).limit(1)
