"""Poisson bootstrap: draws, means and intervals against plain code."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from vireo.operators import resampling as RS


def times(replicate, key):
    h = int(hashlib.md5(f"{replicate}:{key}".encode()).hexdigest()[:8], 16)
    return sum(h >= s for s in RS.poisson_steps())


def test_draws_follow_the_poisson_law():
    steps = RS.poisson_steps()
    assert steps == sorted(set(steps)) and steps[-1] < RS.HASH_RANGE
    shares = np.diff([0, *steps]) / RS.HASH_RANGE
    assert all(abs(s - math.exp(-1) / math.factorial(k)) < 1e-9 for k, s in enumerate(shares))


def test_means_and_intervals(spark):
    rows = [(k, (k * 37 % 101) / 101, None if k % 5 == 0 else float(k % 3)) for k in range(300)] + [(None, 1e9, 1e9)]
    df = spark.createDataFrame(rows, "k long, a double, b double").repartition(7)
    got = {r.replicate: r for r in RS.bootstrap_means(df, "k", ["a", "b"], 40).collect()}
    want = {}
    for rep in range(40):
        w = [(times(rep, k), a, b) for k, a, b in rows if k is not None]
        some = [(n, b) for n, _, b in w if b is not None]
        want[rep] = (sum(n for n, _, _ in w), sum(n * a for n, a, _ in w) / sum(n for n, _, _ in w), sum(n * b for n, b in some) / sum(n for n, _ in some))
    assert set(got) == set(want)
    for rep, (n, a, b) in want.items():
        assert got[rep].n == n and abs(got[rep].a - a) < 1e-12 and abs(got[rep].b - b) < 1e-12
    found = {r.metric: r for r in RS.bootstrap_intervals(RS.bootstrap_means(df, "k", ["a", "b"], 40), ["a", "b"], 0.9).collect()}
    for at, m in enumerate("ab", 1):
        assert np.allclose([found[m].low, found[m].median, found[m].high], np.percentile([w[at] for w in want.values()], [5, 50, 95]))


def test_nothing_to_draw_from(spark):
    none = spark.createDataFrame([], "k long, a double")
    assert RS.bootstrap_means(none, "k", ["a"]).count() == 0
    assert RS.bootstrap_intervals(RS.bootstrap_means(none, "k", ["a"]), ["a"]).count() == 0
    one = spark.createDataFrame([("x", None)], "k string, a double")
    assert {r.a for r in RS.bootstrap_means(one, "k", ["a"], 20).collect()} == {None}
    assert one.select(RS.drawn(F.lit(3), F.col("k")).alias("n")).first().n == times(3, "x")
