"""Ranks, running counts and running series over one very large group.

A window without a fine partitioning would send a whole group to one task. Here
values are first collapsed to a histogram (partial aggregation), the value axis
is cut at quantiles into pieces of similar size, windows run inside a piece, and
the few per-piece totals are carried over to the next pieces.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesora.session import materialize, shuffle_width


def split_points(df: DataFrame, value: str, pieces: int) -> list:
    """:func:`split_points_of` one column."""
    return split_points_of(df, [value], pieces)[0]


def split_points_of(df: DataFrame, values: Sequence[str], pieces: int) -> list[list]:
    """At most ``pieces - 1`` quantiles of each numeric column, as literals, from one pass.

    They are read once so that every branch of a plan cuts at the same places,
    also when a stage is computed again. Which places they are does not change
    any result, only the size of the pieces.
    """
    if pieces < 2:
        return [[] for _ in values]
    shares = [i / pieces for i in range(1, pieces)]
    row = df.agg(*[F.percentile_approx(v, shares, 10 * pieces).alias(f"q{i}") for i, v in enumerate(values)]).first()
    return [sorted({float(x) for x in (found or []) if x is not None and math.isfinite(x)}) for found in row]


def cut_at(df: DataFrame, value: str, points: Sequence, out: str) -> DataFrame:
    """Number of the piece a value falls into. A JVM binary search, so thousands of points cost little."""
    if not points:
        return df.withColumn(out, F.lit(0.0))
    splits = [-math.inf, *[float(p) for p in points], math.inf]
    return Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep").transform(df)


def running_by_value(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    *,
    pieces: int | None = None,
) -> DataFrame:
    """One row per ``(group, value)``: each sum, and ``<name>_before`` over smaller values.

    Also ``<name>_total`` over the group.
    """
    pieces = pieces or shuffle_width(df.sparkSession)
    # written once: the cut points, the totals and the local pass all start from it
    hist = materialize(df.groupBy(*group, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "histogram")
    cut = cut_at(hist, value, split_points(hist, value, pieces), "_piece")
    totals = cut.groupBy(*group, "_piece").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    # one row per piece: at most `pieces` rows per group
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        *group,
        "_piece",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    below = Window.partitionBy(*group, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        "*", *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"_l_{n}") for n in sums]
    )
    return local.join(offsets, [*group, "_piece"]).select(
        *group,
        value,
        *sums.keys(),
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(f"{n}_before") for n in sums],
        *[f"{n}_total" for n in sums],
    )


def value_ranks(df: DataFrame, group: Sequence[str], value: str, *, pieces: int | None = None) -> DataFrame:
    """Per ``(group, value)``: tie count, group size, mid-rank and share of values <= value."""
    present = df.where(F.col(value).isNotNull())
    run = running_by_value(present, group, value, {"n": F.lit(1)}, pieces=pieces)
    return run.select(
        *group,
        value,
        F.col("n").alias("ties"),
        F.col("n_total").alias("group_size"),
        (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("mid_rank"),
        ((F.col("n_before") + F.col("n")) / F.col("n_total")).alias("percentile_rank"),
    )


def exact_median(df: DataFrame, group: Sequence[str], value: str, *, pieces: int | None = None) -> DataFrame:
    """Exact median per group, without holding a group's values in one buffer."""
    present = df.where(F.col(value).isNotNull())
    run = running_by_value(present, group, value, {"n": F.lit(1)}, pieces=pieces)
    low = F.expr("(n_total + 1) div 2")
    high = F.expr("(n_total + 2) div 2")
    upto = F.col("n_before") + F.col("n")
    holds_low = (F.col("n_before") < low) & (upto >= low)
    holds_high = (F.col("n_before") < high) & (upto >= high)
    return run.groupBy(*group).agg(
        ((F.max(F.when(holds_low, F.col(value))) + F.max(F.when(holds_high, F.col(value)))) / 2.0).alias("median"),
        F.max("n_total").alias("n"),
    )


# ---- running aggregates along a series ---------------------------------------

_RUNNING = {"sum": F.sum, "min": F.min, "max": F.max}
_JOIN_UP = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def cut_series(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], *, pieces: int | None = None, out: str = "piece") -> DataFrame:
    """Series cut into pieces of similar size along their order; a written table with the piece number.

    Range partitioning over keys and order samples the quantiles, so however a
    series' rows are spread over time a piece holds about the same number. Where
    times repeat, ``order`` names further columns: a series is windowed more than
    once, and rows that tie must stand in the same order each time.
    """
    pieces = pieces or shuffle_width(df.sparkSession)
    along = [order] if isinstance(order, str) else order
    dealt = df.repartitionByRange(pieces, *[F.col(c) for c in (*keys, *along)])
    return materialize(dealt.withColumn(out, F.spark_partition_id()), "series_pieces")


def met(rows: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with the columns of a table of one row per ``on``; null keys meet each other."""
    named = small.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return rows.join(named, same, "left").drop(*[f"_on_{c}" for c in on])


def carried(totals: DataFrame, how: Mapping[str, str], *, keys: Sequence[str], block: str) -> DataFrame:
    """For every block ``_c_<name>``: the sum, min or max of a total over all earlier blocks of its series, null in the first.

    One row a block meets here. Totals may be composed before: the smallest
    running sum of a block, say, plus the carried sum.
    """
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({f"_c_{name}": _RUNNING[h](name).over(earlier) for name, h in how.items()})


def inside(keys: Sequence[str], block: str, order: str | Sequence[str]):
    """Window over the rows of one block up to the current one."""
    return Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def running(
    df: DataFrame,
    cols: Mapping[str, tuple[str, Column]],
    *,
    keys: Sequence[str],
    order: str | Sequence[str],
    block: str | None = None,
) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` up to and including each row of a series.

    ``cols``: new column to (function, input). Without ``block`` a series is one
    window partition, right for series bounded by the calendar. A long series
    names a ``block`` column that never falls along the order (see
    :func:`cut_series`): rows are windowed inside a block, the result is written
    once, and the totals of earlier blocks, one row each, are carried over. So
    one series spreads over as many tasks as it has blocks, and a further
    running pass starts from the written rows, not from the source.
    """
    if block is None:
        by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: _RUNNING[how](c).over(by) for name, (how, c) in cols.items()})
    here = inside(keys, block, order)
    df = df.withColumns({f"_in_{n}": c for n, (_, c) in cols.items()})
    local = df.withColumns({f"_l_{n}": _RUNNING[how](f"_in_{n}").over(here) for n, (how, _) in cols.items()})
    local = materialize(local, "running")
    totals = local.groupBy(*keys, block).agg(*[_RUNNING[how](f"_in_{n}").alias(n) for n, (how, _) in cols.items()])
    offsets = carried(totals, {n: how for n, (how, _) in cols.items()}, keys=keys, block=block)
    joined = met(local, offsets.drop(*cols), [*keys, block])

    def whole(name: str, how: str) -> Column:
        local_, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        return F.when(before.isNull(), local_).when(local_.isNull(), before).otherwise(_JOIN_UP[how](local_, before))

    out = joined.withColumns({n: whole(n, how) for n, (how, _) in cols.items()})
    return out.drop(*[f"{mark}_{n}" for n in cols for mark in ("_in", "_l", "_c")])
