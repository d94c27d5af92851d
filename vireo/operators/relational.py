"""Relational building blocks shared by every family of operators.

The central one is :func:`ordered_prefix`: row numbers and running sums inside
groups that stay correct and balanced when one group holds a large share of all
rows. A plain ``row_number().over(Window.partitionBy(g))`` sends a whole group to
one task; here the rows are range-partitioned on (group, order), so a hot group
is spread over many tasks, numbered locally, and shifted by per-partition
offsets computed from a small count table. :func:`first_in_group` is the form
for the first k rows of each group, which prunes before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_PID, _GRP = "_vireo_pid", "_vireo_grp"


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def ordered_prefix(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                   sums: dict[str, Column] | None = None, pos_col: str = "pos",
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``pos_col`` (1-based bigint row number within each group in ``order_cols``
    order) and, for each ``name -> expr`` of ``sums``, the running sum of ``expr``
    up to and including the row. NULL is a group like any other.

    ``order_cols`` must give a total order inside a group (add a unique
    tie-breaker), otherwise positions of tied rows are arbitrary. The rows are
    range-partitioned once and kept in the shared ``spark.checkpoint.dir``, so
    that both branches below see the same bounds; no group is gathered in one
    task.
    """
    sums = dict(sums or {})
    order = _cols(order_cols)
    # a struct of the group columns is never NULL itself: it joins and partitions NULL groups like others
    group = F.struct(*_cols(group_cols)) if group_cols else F.lit(0)
    tmp = {name: f"_vireo_s{i}" for i, name in enumerate(sums)}
    keyed = df.withColumns({**{tmp[name]: expr for name, expr in sums.items()}, _GRP: group})
    by = [*_cols(group_cols), *order]
    ranged = keyed.repartitionByRange(num_partitions, *by) if num_partitions else keyed.repartitionByRange(*by)
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.withColumn(_PID, F.spark_partition_id()).checkpoint(eager=True)
    part = [_PID, _GRP]
    # local numbering inside (partition, group): bounded by one partition
    wl = Window.partitionBy(*part).orderBy(*order)
    run = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_vireo_lpos", F.row_number().over(wl))
    for t in tmp.values():
        local = local.withColumn(f"_vireo_l{t}", F.sum(t).over(run))
    # totals of each (partition, group) -> offsets of the partitions before it (small table)
    stats = ranged.groupBy(*part).agg(F.count(F.lit(1)).alias("_vireo_cnt"), *[F.sum(t).alias(f"_vireo_t{t}") for t in tmp.values()])
    wo = Window.partitionBy(_GRP).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(*part, F.coalesce(F.sum("_vireo_cnt").over(wo), F.lit(0)).alias("_vireo_off"),
                           *[F.coalesce(F.sum(f"_vireo_t{t}").over(wo), F.lit(0)).alias(f"_vireo_o{t}") for t in tmp.values()])
    # the join keys are the window keys, so the large side is not shuffled again
    out = local.join(offsets, part).withColumn(pos_col, F.col("_vireo_off") + F.col("_vireo_lpos"))
    for name, t in tmp.items():
        out = out.withColumn(name, F.col(f"_vireo_o{t}") + F.col(f"_vireo_l{t}"))
    return out.select(*df.columns, pos_col, *sums)


def first_in_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, k: int,
                   sums: dict[str, Column] | None = None, pos_col: str = "pos") -> DataFrame:
    """The rows of :func:`ordered_prefix` with position ``k`` or less.

    Positions and running sums up to k depend on the first k rows alone, so the
    rest is pruned first: each task passes on at most k rows of a group.
    """
    top = top_k_per_group(df, group_cols, order_cols, k, pos_col).withColumn(pos_col, F.col(pos_col).cast("long"))
    w = Window.partitionBy(*group_cols).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top.withColumns({name: F.sum(expr).over(w) for name, expr in (sums or {}).items()})


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                    k: int, rank_col: str | None = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each group in ``order_cols`` order.

    ``row_number() <= k`` directly on the window is planned as a partial
    WindowGroupLimit before the shuffle, so each map task forwards at most ``k``
    rows per group: a hot group never reaches one task whole.
    """
    w = Window.partitionBy(*group_cols).orderBy(*_cols(order_cols))
    rn = rank_col or "_vireo_rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)


def global_rank(df: DataFrame, order_cols: Sequence, pos_col: str = "pos") -> DataFrame:
    """Row number over the whole frame without a single-partition window."""
    return ordered_prefix(df, [], order_cols, pos_col=pos_col)


def fixed_batches(df: DataFrame, order_cols: Sequence, batch_size: int,
                  batch_col: str = "batch") -> DataFrame:
    """Assign consecutive rows (in ``order_cols`` order) to batches of ``batch_size``."""
    ranked = global_rank(df, order_cols, pos_col="_vireo_pos")
    return ranked.withColumn(batch_col, F.floor((F.col("_vireo_pos") - 1) / batch_size).cast("long")) \
        .drop("_vireo_pos")


def nth_key(df: DataFrame, order_cols: Sequence[str], n: int) -> Column:
    """Lazy scalar: the ``n``-th smallest ``struct(order_cols)`` (the largest if
    there are fewer rows). A top-n with a partial limit per task; nothing of
    the data is shuffled. ``n`` keys pass one task: it is a parameter, like the
    k of a top-k, and does not grow with the data."""
    key = F.struct(*[F.col(c) for c in order_cols]).alias("_vireo_key")
    return df.select(key).orderBy("_vireo_key").limit(n).select(F.max("_vireo_key")).scalar()


def positional_splits(df: DataFrame, order_cols: Sequence[str], sizes: Sequence[int],
                      labels: Sequence[str], rest_label: str, split_col: str = "split") -> DataFrame:
    """Consecutive row ranges in ``order_cols`` order: the first ``sizes[0]`` rows
    get ``labels[0]``, the next ``sizes[1]`` ``labels[1]``, ...; the rest
    ``rest_label``. ``order_cols`` must be unique. The bounds are keys from lazy
    top-n scalars (:func:`nth_key`)."""
    bounds = [sum(sizes[:i + 1]) for i in range(len(sizes))]
    key = F.struct(*[F.col(c) for c in order_cols])
    label = F.lit(rest_label)
    for bound, lab in reversed(list(zip(bounds, labels))):
        label = F.when(key <= nth_key(df, order_cols, bound), F.lit(lab)).otherwise(label)
    return df.withColumn(split_col, label)


def positional_split(df: DataFrame, order_cols: Sequence[str], n_first: int,
                     first_label: str = "validation", rest_label: str = "train",
                     split_col: str = "split") -> DataFrame:
    """First ``n_first`` rows (in ``order_cols`` order) get ``first_label``."""
    return positional_splits(df, order_cols, [n_first], [first_label], rest_label, split_col)


def last_record(df: DataFrame, order_col: str) -> DataFrame:
    """The last row by ``order_col`` (top-1, partial per task before the merge)."""
    return df.orderBy(F.col(order_col).desc()).limit(1)


def sample_one(df: DataFrame, keys: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Deterministic one-row sample: the row with the smallest seeded hash of its
    key columns (``keys`` should identify a row). A top-1: each task keeps one
    candidate before the merge. The hash is md5 of ``key|key|...|seed``, so any
    engine with md5 picks the same row."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in ks], F.lit(str(seed))))
    return df.orderBy(h, *[F.col(k) for k in ks]).limit(1)


def lookup(df: DataFrame, table: DataFrame, on, value_cols: Sequence[str],
           default=None) -> DataFrame:
    """Left lookup join; the planner decides on the form by the dictionary's bytes.

    ``default`` fills values of keys missing from the dictionary (reference
    behaviour for unknown label ids is the empty string).
    """
    out = df.join(table, on=on, how="left")
    if default is not None:
        for c in value_cols:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(default)))
    return out
