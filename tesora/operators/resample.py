"""Intervals by resampling units (blocks of a series, events, territories) with weights from a counter-based generator.

A replicate is a set of weights, one a unit, never a copy of rows. Weights are
Poisson with mean one, the form of the bootstrap that needs no total: any task
can weigh its units alone, so a group of any size is summed by partial
aggregation and ships one number a replicate. A weight depends on the seed, the
group, the unit and the replicate only, through a digest that other engines have
too; reruns and other partitionings draw the same.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import safe_ratio
from tesora.session import shuffle_width

REPLICATES = 2000
LEVEL = 0.95
#: Fewer units than this give no interval.
LEAST_UNITS = 10
#: Numbers drawn are below this: seven hexadecimal digits of an MD5 digest.
RANGE = 1 << 28
#: A weight is the number of these that the drawn number reaches: the Poisson distribution function, mean one.
POISSON = tuple(math.floor(RANGE * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(11))


def hashed(*columns: Column | str) -> Column:
    """A number below ``RANGE`` that any engine with MD5 gives for the same texts."""
    text = F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def hashed_sql(*columns: str) -> str:
    text = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT)"


def weight(number: Column) -> Column:
    """The Poisson weight of a drawn number."""
    return sum((F.when(number >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def weight_sql(number: str) -> str:
    return f"len(list_filter([{', '.join(map(str, POISSON))}], lambda p: {number} >= p))"


@dataclass(frozen=True)
class Resampling:
    replicates: int = REPLICATES
    level: float = LEVEL
    seed: int = 1
    least_units: int = LEAST_UNITS

    def __post_init__(self) -> None:
        if self.replicates < 100 or not 0 < self.level < 1 or  self.least_units < 1:
            raise ValueError("replicates must be >= 100, level in (0, 1), least_units >= 1")


def blocks(df: DataFrame, *, keys: Sequence[str], order: str, length: int, out: str = "block") -> DataFrame:
    """Rows of each series with the number of their block of ``length`` rows; a series is bounded by its calendar."""
    if length < 1:
        raise ValueError("length must be >= 1")
    by = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.floor((F.row_number().over(by) - 1) / length).cast("long"))


def weighted_units(units: DataFrame, keys: Sequence[str], unit: Sequence[str], plan: Resampling) -> DataFrame:
    """One row per unit and replicate ``_r``, with its weight ``_w``.

    Units are few against their draws, so they are dealt out before the draws
    are made. Rows of weight zero stay: a filter on the weight would be pushed
    below the draw and repeat it for every threshold.
    """
    spread = units.repartition(shuffle_width(units.sparkSession), *keys, *unit)
    named = spread.withColumn("_u", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, *unit)]))
    paired = named.select("*", F.explode(F.sequence(F.lit(1), F.lit(plan.replicates))).alias("_r"))
    drawn = paired.withColumn("_draw", hashed(F.lit(plan.seed), "_r", "_u"))
    return drawn.withColumn("_w", weight(F.col("_draw"))).drop("_u", "_draw")


def ratio_interval(
    df: DataFrame, *, keys: Sequence[str], unit: Sequence[str], numerator: Column, denominator: Column | None = None, plan: Resampling = Resampling()
) -> DataFrame:
    """Ratio of two sums per group (the mean without a denominator) with its percentile interval.

    ``(keys, units, estimate, lower, upper, share_above)``: ``share_above`` is the
    share of replicates above zero. Rows with a null in either part do not count.
    Groups with fewer than ``least_units`` units have an estimate and no interval.
    """
    den = F.lit(1.0) if denominator is None else denominator.cast("double")
    rows = df.select(*keys, *unit, numerator.cast("double").alias("_a"), den.alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    units = rows.groupBy(*keys, *unit).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    whole = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), safe_ratio(F.sum("_a"), F.sum("_b")).alias("estimate"))
    drawn_rows = weighted_units(units, keys, unit, plan)
    sums = drawn_rows.groupBy(*keys, "_r").agg(F.sum(F.col("_w") * F.col("_a")).alias("_a"), F.sum(F.col("_w") * F.col("_b")).alias("_b"))
    return _intervals(whole, sums.select(*keys, safe_ratio("_a", "_b").alias("_v")), keys, plan)


def quantile_interval(
    df: DataFrame, *, keys: Sequence[str], unit: Sequence[str], value: str, q: float = 0.5, plan: Resampling = Resampling()
) -> DataFrame:
    """A quantile of one value a unit (lead times, delays), the smallest value that reaches the share ``q``, with its interval.

    Units with equal values collapse per replicate before they are ordered.
    """
    units = df.select(*keys, *unit, F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL")

    def reached(counted: DataFrame, group: Sequence[str]) -> DataFrame:
        by = Window.partitionBy(*group)
        along = by.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
        held = counted.withColumns({"_upto": F.sum("_n").over(along), "_all": F.sum("_n").over(by)})
        return held.where(F.col("_upto") >= q * F.col("_all")).groupBy(*group).agg(F.min("_x").alias("_v"))

    plain = units.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))
    sizes = plain.groupBy(*keys).agg(F.sum("_n").alias("units"))
    whole = sizes.join(reached(plain, keys).withColumnRenamed("_v", "estimate"), list(keys))
    drawn_rows = weighted_units(units, keys, unit, plan).groupBy(*keys, "_r", "_x").agg(F.sum("_w").alias("_n")).where("_n > 0")
    return _intervals(whole, reached(drawn_rows, [*keys, "_r"]).drop("_r"), keys, plan)


def _intervals(whole: DataFrame, values: DataFrame, keys: Sequence[str], plan: Resampling) -> DataFrame:
    """At most one value a replicate meets here, so the exact percentiles are over a bounded number."""
    ends = F.percentile("_v", F.array(F.lit((1 - plan.level) / 2), F.lit((1 + plan.level) / 2)))
    found = values.where("_v IS NOT NULL").groupBy(*keys).agg(ends.alias("_e"), F.avg((F.col("_v") > 0).cast("double")).alias("_s"))
    joined = whole.join(found, list(keys), "left")
    enough = F.col("units") >= plan.least_units
    return joined.select(
        *keys,
        "units",
        "estimate",
        F.when(enough, F.col("_e")[0]).alias("lower"),
        F.when(enough, F.col("_e")[1]).alias("upper"),
        F.when(enough, F.col("_s")).alias("share_above"),
    )
