"""Explicit ALS with the errors of every iteration: a whole grid from one run.

A fit of ``n`` iterations passes through the factors of all shorter fits, so a grid of
(lambda, rank, iterations) needs no fit of its own for each number of iterations. A half
step solves, for every id, its regularised least squares given the factors of the other
side, for all lambdas and ranks at once: an id is one row with the factors of the whole grid.

The ratings are dealt once into blocks, by ranges of the side with more ids, and stay there. A half
step brings to each block the factors it needs, once for each id, and adds up the normal equations
inside. Ids of one block alone are solved in it; of ids in several blocks (a hot one, and all of the
side with fewer ids) each block passes on one row of sums. Validation rows lie in the same blocks and
are scored after every iteration. So what travels grows with the ids of a block, not with
ratings times grid points. The error on the training rows and the penalised objective follow from the
same sums; only the validation rows are scored again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

FACTORS = "block int, id long, v array<double>, gain array<double>, penalty array<double>, sums array<double>"
BLOCK = 1 << 20      # ratings of a block, about
CHUNK = 1 << 14      # ratings whose products are held at once


class Layout:
    """Places of (rank, lambda) in the factors and in the sums (count, sum r v, upper triangle of sum v v') of an id."""

    def __init__(self, ranks, lambdas):
        self.parts, self.width, self.held = [], 0, 0
        for k in ranks:
            for lam in lambdas:
                size = 1 + k + k * (k + 1) // 2
                self.parts.append((k, float(lam), slice(self.width, self.width + k), slice(self.held, self.held + size)))
                self.width, self.held = self.width + k, self.held + size


def _matrix(column, n):
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _lists(m):
    import pyarrow as pa

    return pa.FixedSizeListArray.from_arrays(m.ravel(), m.shape[1]).cast(pa.list_(pa.float64()))


def _added(at, n, rating, v):
    """Normal equations of ``n`` ids: row i belongs to id ``at[i]`` (rising), has ``rating[i]`` and the factors ``v[i]``."""
    import numpy as np

    k = v(slice(0, 0)).shape[1]
    i, j = np.triu_indices(k)
    out = np.zeros((n, 1 + k + len(i)))
    for begin in range(0, len(at), CHUNK):
        rows = slice(begin, begin + CHUNK)
        x, ids = v(rows), at[rows]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        products = np.concatenate([np.ones((len(x), 1)), rating[rows, None] * x, x[:, i] * x[:, j]], axis=1)
        out[ids[first]] += np.add.reduceat(products, first, axis=0)
    return out


def _solved(k, lam, sums):
    """Factors, with b.v (gain) and n |v|^2 (penalty)."""
    import numpy as np

    n, b, a = sums[:, 0], sums[:, 1:k + 1], np.empty((len(sums), k, k))
    i, j = np.triu_indices(k)
    a[:, i, j] = a[:, j, i] = sums[:, k + 1:]
    a[:, range(k), range(k)] += (lam * n)[:, None]
    v = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    return v, (b * v).sum(axis=1), n * (v * v).sum(axis=1)


def _factors(layout, block, ids, sums_of):
    """Rows of FACTORS for ids whose sums are whole; ``sums_of`` gives the sums of a place of the grid."""
    import numpy as np
    import pyarrow as pa

    v, gain, penalty = np.empty((len(ids), layout.width)), *np.empty((2, len(ids), len(layout.parts)))
    for g, (k, lam, place, _) in enumerate(layout.parts):
        v[:, place], gain[:, g], penalty[:, g] = _solved(k, lam, sums_of(g))
    return [pa.array(np.full(len(ids), block, np.int32), mask=np.full(len(ids), block < 0)), pa.array(ids, pa.int64()),
            _lists(v), _lists(gain), _lists(penalty), pa.nulls(len(ids), pa.list_(pa.float64()))]


NAMES = ["block", "id", "v", "gain", "penalty", "sums"]


def _in_block(layout, solve, given, spread):
    """Cogroup of a block's ratings and the factors of the ids in column ``given``: factors of the ids in column ``solve``, or
    sums of those in ``spread`` (None: of all)."""

    def run(rows, factors):
        import numpy as np
        import pyarrow as pa

        ids, others, rating = (rows.column(c).to_numpy() for c in (solve, given, "rating"))
        known = factors.column("id").to_numpy()
        if not len(ids) or not len(known):
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 4)], names=NAMES)
        order = np.argsort(known, kind="stable")
        known, v = known[order], _matrix(factors.column("v"), len(known))[order]
        at = np.minimum(np.searchsorted(known, others), len(known) - 1)
        use = np.flatnonzero(known[at] == others)
        use = use[np.argsort(ids[use], kind="stable")]
        at, rating = at[use], rating[use]
        found, of = np.unique(ids[use], return_inverse=True)
        part = np.ones(len(found), bool) if spread is None else np.isin(found, spread)
        whole, held = np.flatnonzero(~part), np.empty((part.sum(), layout.held))

        def sums_of(g):
            _, _, place, sums = layout.parts[g]
            out = _added(of, len(found), rating, lambda r: v[at[r], place])
            held[:, sums] = out[part]
            return out[whole]

        done = _factors(layout, rows.column("block")[0].as_py(), found[whole], sums_of)
        none = pa.nulls(len(held), pa.list_(pa.float64()))
        more = [pa.nulls(len(held), pa.int32()), pa.array(found[part], pa.int64()), none, none, none, _lists(held)]
        return pa.table([pa.chunked_array([a, b]) for a, b in zip(done, more)], names=NAMES)

    return run


def _solve(layout):
    """Sums sorted by id -> factors; the last id of a batch waits for the next batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(ids, sums):
            return pa.record_batch(_factors(layout, -1, ids, lambda g: sums[:, layout.parts[g][3]]), names=NAMES)

        ids, sums = np.zeros(0, np.int64), np.zeros((0, layout.held))
        for rb in batches:
            for begin in range(0, rb.num_rows, 1024):
                rows = rb.slice(begin, 1024)
                ids = np.r_[ids, rows.column("id").to_numpy()]
                sums = np.r_[sums, _matrix(rows.column("sums"), rows.num_rows)]
                first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                ids, sums = ids[first], np.add.reduceat(sums, first, axis=0)
                if len(ids) > 1:
                    yield out(ids[:-1], sums[:-1])
                    ids, sums = ids[-1:], sums[-1:]
        if len(ids):
            yield out(ids, sums)

    return run


def _merged(layout, sums):
    return sums.select("id", "sums").repartition("id").sortWithinPartitions("id").mapInArrow(_solve(layout), FACTORS)


def starting_factors(ids: DataFrame, ranks: Sequence[int], lambdas: Sequence[float], seed: int) -> DataFrame:
    """Positive numbers below 1 / sqrt(rank) from a hash of id, place and seed: the same for every lambda and every run."""
    made = [ids.select(F.lit(k).alias("rank"), F.explode(F.array(*[F.lit(float(x)) for x in lambdas])).alias("lam"), "id",
                       _start(k, seed).alias("v")) for k in ranks]
    return reduce(DataFrame.unionByName, made)


def _start(k, seed):
    number = lambda j: (F.pmod(F.xxhash64("id", F.lit(j), F.lit(seed)), F.lit(1 << 30)) + 1) / float(1 << 30) / k ** 0.5
    return F.array(*[number(j) for j in range(k)])


class _Blocks:
    """The ratings in their blocks. ``home``: the side whose ids are dealt by ranges; ``away``: the other."""

    def __init__(self, rows, valid, layout):
        spark = rows.sparkSession
        n, users, items = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("user"), F.approx_count_distinct("item")).first()
        home, away = ("user", "item") if users >= items else ("item", "user")
        n += valid.count()
        blocks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // BLOCK))
        both = rows.withColumn("held", F.lit(False)).unionByName(valid.withColumn("held", F.lit(True)))
        # repeated rows of one pair are numbered, so that they need not meet in one block either
        dealt = both.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(blocks, home, away, "_n").drop("_n")
        dealt = dealt.withColumn("block", F.spark_partition_id()).checkpoint()
        # more partitions than blocks, so that few blocks share one; the stored rows are not dealt again
        place = lambda held: dealt.where(F.col("held") == held).select("block", "user", "item", "rating") \
            .repartition(4 * blocks, "block").sortWithinPartitions("block").checkpoint()
        self.layout, self.home, self.away, self.train, self.held = layout, home, away, place(False), place(True)
        # every block that has the id, in a training or validation row
        self.route = {s: dealt.select("block", F.col(s).alias("id")).distinct().checkpoint() for s in (home, away)}
        per_id = self.route[home].groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        self.spread = [r["id"] for r in per_id.collect()]            # they lie across borders: fewer than blocks

    def brought(self, factors, side):
        """(block, side, id, v): the factors of a side in every block that has the id."""
        # fresh aliases: with shared attribute ids the cogroup could not tell its sides apart
        take = lambda d: d.select(F.col("block").alias("block"), F.lit(side).alias("side"), F.col("id").alias("id"), F.col("v").alias("v"))
        far = take(factors.where("block IS NULL").drop("block").join(self.route[side], "id"))
        return far if side == self.away else take(factors.where("block IS NOT NULL")).unionByName(far)

    def half_step(self, side, factors):
        """The factors of a side from those of the other one."""
        other = self.away if side == self.home else self.home
        spread = self.spread if side == self.home else None
        got = self.train.groupBy("block").cogroup(self.brought(factors, other).groupBy("block")) \
            .applyInArrow(_in_block(self.layout, side, other, spread), FACTORS)
        if spread is None:
            return _merged(self.layout, got).checkpoint()
        got = got.checkpoint()
        return got.where("sums IS NULL").unionByName(_merged(self.layout, got.where("sums IS NOT NULL")).checkpoint()) if spread else got

    def errors(self, users, items):
        """{place of the grid: (sum of squared errors, rows)} of the validation rows whose user and item are known."""
        layout = self.layout

        def run(rows, factors):
            import numpy as np
            import pyarrow as pa

            ss, at, use = np.zeros(len(layout.parts)), {}, np.ones(rows.num_rows, bool)
            v = _matrix(factors.column("v"), factors.num_rows) if factors.num_rows else np.zeros((0, layout.width))
            for side in ("user", "item"):
                mine = np.flatnonzero(factors.column("side").to_numpy(zero_copy_only=False) == side)
                known = factors.column("id").to_numpy()[mine]
                order = np.argsort(known, kind="stable")
                wanted = rows.column(side).to_numpy()
                place = np.searchsorted(known[order], wanted)
                use &= place < len(known)
                at[side] = mine[order][np.minimum(place, len(known) - 1)] if len(known) else np.zeros(len(wanted), int)
                use &= (factors.column("id").to_numpy()[at[side]] == wanted) if len(known) else False
            rating, x, y = rows.column("rating").to_numpy()[use], at["user"][use], at["item"][use]
            for begin in range(0, len(x), CHUNK):
                r = slice(begin, begin + CHUNK)
                products = v[x[r]] * v[y[r]]
                for g, (_, _, place, _) in enumerate(layout.parts):
                    ss[g] += np.square(products[:, place].sum(axis=1) - rating[r]).sum()
            return pa.table({"place": pa.array(np.arange(len(ss), dtype=np.int32)), "ss": pa.array(ss), "n": pa.array(np.full(len(ss), len(x)))})

        given = self.brought(users, "user").unionByName(self.brought(items, "item"))
        got = self.held.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, "place int, ss double, n long")
        return {r["place"]: (r["ss"], r["n"]) for r in got.groupBy("place").agg(F.sum("ss").alias("ss"), F.sum("n").alias("n")).collect()}

    def unpacked(self, factors, it):
        """One row for every place of the grid: iters, rank, lam, id, v."""
        cells = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(lam).alias("lam"), F.slice("v", p.start + 1, k).alias("v")) for k, lam, p, _ in self.layout.parts])
        return factors.select("id", F.explode(cells).alias("c")).select(F.lit(it).alias("iters"), "c.rank", "c.lam", "id", "c.v")

    def totals(self, factors):
        """(gain, penalty) of every place of the grid, over all ids."""
        many = range(len(self.layout.parts))
        r = factors.agg(*[F.sum(F.col(c)[g]).alias(f"{c}{g}") for c in ("gain", "penalty") for g in many]).first()
        return [(r[f"gain{g}"], r[f"penalty{g}"]) for g in many]


POINTS = "grid_pos int, lam double, rank int, iters int, train_rmse double, val_rmse double, n_scored long, objective double, is_best boolean"


def validation_path(train: DataFrame, valid: DataFrame, ranks: Sequence[int], lambdas: Sequence[float], iterations: int, seed: int = 42):
    """(points, users, items) of the whole grid, from one run of ``iterations`` iterations.

    ``points``: grid_pos, lam, rank, iters, train_rmse, val_rmse, n_scored, objective, is_best for every lambda, rank
    and 1 .. ``iterations``, numbered in that order; the least ``val_rmse`` is best, the first of equal ones. A
    validation row whose user or item was not trained on adds no error but counts in the mean, as in
    :func:`recommend.als_rmse`. ``users``, ``items``: iters, rank, lam, id, v after each iteration. ``train``, ``valid``:
    user, item, rating, ids of any integral width; rows with a null are left out, repeated rows count as often as
    they occur. Penalties are weighted by the number of ratings (lambda x n), which must be positive. The objective
    is the sum of squared errors and penalties that each half step makes least; it never rises.

    Each half step reads the stored blocks of ratings once, and its factors are kept in the shared checkpoint folder.
    """
    if iterations < 1 or not ranks or min(ranks) < 1 or not lambdas or min(lambdas) <= 0:
        raise ValueError("iterations, ranks and lambdas must be positive")
    if len(set(ranks)) < len(ranks) or len(set(lambdas)) < len(lambdas):
        raise ValueError("ranks and lambdas must differ")
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    take = lambda df: df.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"),
                                F.col("rating").cast("double").alias("rating")).dropna()
    layout = Layout(ranks, lambdas)
    blocks = _Blocks(take(train), take(valid), layout)
    n, squares = blocks.train.agg(F.count(F.lit(1)), F.sum(F.col("rating") * F.col("rating"))).first()
    n_valid = blocks.held.count()
    start = F.concat(*[_start(k, seed) for k, _, _, _ in layout.parts])
    none = F.lit(None)
    items = blocks.train.select(F.col("item").alias("id")).distinct().select(none.cast("int").alias("block"), "id", start.alias("v"))
    found, steps = [], []
    for it in range(1, iterations + 1):
        users = blocks.half_step("user", items)
        items = blocks.half_step("item", users)
        steps.append((blocks.unpacked(users, it), blocks.unpacked(items, it)))
        if n:
            errors = blocks.errors(users, items)
            for g, ((_, up), (gain, ip)) in enumerate(zip(blocks.totals(users), blocks.totals(items))):
                k, lam = layout.parts[g][:2]
                ss, scored = errors.get(g, (0.0, 0))
                pos = ([float(x) for x in lambdas].index(lam) * len(ranks) + list(ranks).index(k)) * iterations + it - 1
                # after the item step: squared errors + item penalties = sum r^2 - sum b.v
                found.append((pos, lam, k, it, (max(squares - gain - lam * ip, 0.0) / n) ** 0.5, (ss / n_valid) ** 0.5 if n_valid else None,
                              scored, squares - gain + lam * up))
    best = min(found, key=lambda p: (p[5] is not None, p[5] or 0.0, p[0]))[0] if found else None
    points = spark.createDataFrame([(*p, p[0] == best) for p in sorted(found)], POINTS)      # one row per grid point
    return points, *(reduce(DataFrame.unionByName, side) for side in zip(*steps))


def with_descent(points: DataFrame) -> DataFrame:
    """``points`` with ``descends``: whether the objective is no higher than an iteration before (rounding apart)."""
    before = F.lag("objective").over(Window.partitionBy("rank", "lam").orderBy("iters"))
    return points.withColumn("descends", F.coalesce(F.col("objective") <= before * (1 + 1e-9) + 1e-9, F.lit(True)))
