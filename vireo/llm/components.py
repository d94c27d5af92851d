"""Connected components: contraction within tasks, then large-star and small-star rounds.

Links are first contracted to stars in tasks of about ``IN_ONE`` links each;
where one such task holds all, that is the result. Otherwise rounds follow.
Each round is two grouped minima and two equi-joins; a node with very many
links is only ever aggregated with map-side partials or met in a join whose
large side the adaptive skew handling splits. Nothing reaches the driver but
one (count, checksum) row per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


IN_ONE = 1_000_000      # links contracted by one task


def _forest(batches):
    """Stars of a partition's links: (node, root) of every linked node that is not a root."""
    import numpy as np
    import pyarrow as pa

    def stars(a, b):
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = list(range(len(nodes)))

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        n = len(a)
        for x, y in zip(at[:n].tolist(), at[n:].tolist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        tops = np.array([root(x) for x in range(len(nodes))], np.int64)
        moved = tops != np.arange(len(nodes))
        return nodes[moved], nodes[tops[moved]]

    u = v = np.zeros(0, np.int64)
    for rb in batches:
        u, v = stars(np.concatenate([u, rb.column(0).to_numpy()]), np.concatenate([v, rb.column(1).to_numpy()]))
    yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``links`` (a, b) of long nodes -> (node, root) for every linked node, root the smallest node.

    Self links and repeated links are allowed; an empty input gives an empty
    result. Raises if ``max_rounds`` did not settle it (never observed; the
    rounds grow with the logarithm of the longest chain).
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    e = cut(e)
    parts = -(-e.count() // IN_ONE)
    e = cut(e.coalesce(max(1, parts)).mapInArrow(_forest, "u long, v long"))
    if parts <= 1:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        hop = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(hop.union(low.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
