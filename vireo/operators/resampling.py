"""Sampling with replacement: Poisson bootstrap of per-key figures.

Each key enters a replicate as often as a Poisson(1) number says, drawn from the
md5 hash of (replicate, key). So the draws need no numbering of the keys, no
collected sample and no state: any task finds the same number for a key, a lost
task draws the same again, and another engine can repeat it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def poisson_steps() -> list[int]:
    """Step k is the number of 32-bit hashes that draw k or less, for every k short of the whole range."""
    steps, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        step = round(total * HASH_RANGE)
        if step >= HASH_RANGE:
            return steps
        steps.append(step)
        k += 1


def drawn(replicate: Column, key: Column) -> Column:
    """How often ``key`` is in ``replicate``: the steps that the first 32 bits of md5('<replicate>:<key>') reach.
    A NULL key is never drawn."""
    text = F.concat(replicate.cast("string"), F.lit(":"), key.cast("string"))
    hashed = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    # most draws reach no or one step: the first that is not reached ends the search
    times = F.when(hashed.isNull(), F.lit(0))
    steps = poisson_steps()
    for k, step in enumerate(steps):
        times = times.when(hashed < F.lit(step), F.lit(k))
    return times.otherwise(F.lit(len(steps)))


def bootstrap_means(df: DataFrame, key: str, metrics: Sequence[str], replicates: int = 200) -> DataFrame:
    """(replicate, n, metrics..): mean of each metric over the keys drawn, and how many were drawn.

    ``df`` holds one row per key. All replicates come from one pass: a task adds up
    its rows for each replicate, so only ``replicates`` rows per task are shuffled.
    A NULL metric is left out of its own mean; a replicate that drew nothing has no row.
    """
    row = df.select(F.col(key).alias("_key"), *metrics)
    rep = row.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rep = rep.withColumn("_n", drawn(F.col("replicate"), F.col("_key"))).where("_n > 0")
    mean = [(F.sum(F.col("_n") * F.col(m)) / F.sum(F.when(F.col(m).isNotNull(), F.col("_n")))).alias(m) for m in metrics]
    return rep.groupBy("replicate").agg(F.sum("_n").alias("n"), *mean)


def bootstrap_intervals(means: DataFrame, metrics: Sequence[str], level: float = 0.95) -> DataFrame:
    """(metric, low, median, high): percentiles of the replicates' means (interpolated), one row per metric."""
    tail = (1 - level) / 2
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("t")).select("t.*")
    cut = lambda p: F.percentile("x", F.lit(p))
    return rows.groupBy("metric").agg(cut(tail).alias("low"), cut(0.5).alias("median"), cut(1 - tail).alias("high"))
