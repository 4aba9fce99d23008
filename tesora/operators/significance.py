"""Tests of the forecasting, discrimination and utility hypotheses, over all series or groups at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import safe_ratio
from tesora.operators.prefix import running_by_value
from tesora.operators.resample import Resampling, blocks, ratio_interval
from tesora.session import materialize

# Comparable errors that the loss test needs, events of each class that the area test needs,
# level of the tests, smallest relative loss reduction that counts.
LEAST_ERRORS = 30
LEAST_EVENTS = 20
ALPHA = 0.05
LEAST_REDUCTION = 0.05


# ---- distributions as column expressions -------------------------------------


def _product_sum(count: Column, ratio, factor: Column) -> Column:
    """1 + r(1) f + r(1) r(2) f^2 + ... with ``count`` terms in all, none below one."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def add(held: Column, j: Column) -> Column:
        return F.struct((held["term"] * ratio(j) * factor).alias("term"), (held["sum"] + held["term"]).alias("sum"))

    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, add, lambda held: held["sum"])


def student_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) for whole degrees of freedom, by the finite series in the cosine of atan(t / sqrt(freedom))."""
    angle = F.atan(F.abs(t) / F.sqrt(freedom.cast("double")))
    cosine, sine = F.cos(angle), F.sin(angle)
    half = F.floor(freedom / 2).cast("int")
    square = cosine * cosine
    even = sine * _product_sum(half, lambda j: (2 * j - 1) / (2.0 * j), square)
    odd = (angle + sine * cosine * _product_sum(half, lambda j: (2.0 * j) / (2 * j + 1), square)) * (2 / math.pi)
    inside = F.when(freedom % 2 == 0, even).otherwise(F.when(freedom == 1, angle * (2 / math.pi)).otherwise(odd))
    return F.greatest(F.lit(0.0), 1.0 - inside)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) by the series of odd powers over odd factorials, whose terms are all positive."""
    x = F.least(F.abs(z), F.lit(9.0))
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    inside = 2 * density * x * _product_sum(F.lit(160), lambda j: 1.0 / (2 * j + 1), x * x)
    return F.greatest(F.lit(0.0), 1.0 - inside)


# ---- forecasts ---------------------------------------------------------------


def diebold_mariano(
    df: DataFrame, *, keys: Sequence[str], order: str, loss_a: Column, loss_b: Column, horizon: int = 1
) -> DataFrame:
    """Test of equal expected loss of two forecasts of a series, with the small-sample correction.

    ``(keys, errors, mean_a, mean_b, difference, variance, statistic, p_value)``.
    ``difference`` is positive where b loses less. Its long-run variance takes the
    autocovariances below the horizon; the statistic is null where that is not
    positive. Rows in which either loss is null do not count.
    """
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    rows = df.select(*keys, order, loss_a.cast("double").alias("_a"), loss_b.cast("double").alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    by = Window.partitionBy(*keys)
    along = by.orderBy(order)
    rows = rows.withColumn("_d", F.col("_a") - F.col("_b"))
    rows = rows.withColumn("_c", F.col("_d") - F.avg("_d").over(by))
    rows = rows.withColumns({f"_g{k}": F.col("_c") * F.lag("_c", k).over(along) for k in range(1, horizon)})
    # windows and sums share the clustering by series
    flat = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("errors"),
        F.avg("_a").alias("mean_a"),
        F.avg("_b").alias("mean_b"),
        F.avg("_d").alias("difference"),
        (F.sum(F.col("_c") * F.col("_c")) + sum((2 * F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)) for k in range(1, horizon)), F.lit(0.0))).alias("_v"),
    )
    n = F.col("errors").cast("double")
    variance = F.col("_v") / n
    correction = F.greatest(F.lit(0.0), (n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
    flat = flat.withColumn("variance", variance)
    statistic = F.when(F.col("variance") > 0, F.col("difference") / F.sqrt(F.col("variance") / n) * F.sqrt(correction))
    flat = flat.withColumn("statistic", F.when(F.col("errors") > 1, statistic))
    p = F.when(F.col("statistic").isNotNull(), student_two_sided(F.col("statistic"), F.col("errors") - 1))
    return flat.withColumn("p_value", p).drop("_v")


def loss_test(
    df: DataFrame, *, keys: Sequence[str], order: str, loss_a: Column, loss_b: Column, horizon: int = 1, block: int = 3, plan: Resampling = Resampling()
) -> DataFrame:
    """Does b forecast better than a? The loss test with enough errors, else the interval of the mean difference over blocks.

    Adds ``method``, ``lower``, ``upper``, ``reduction`` (of the mean loss) and
    ``accepted``: significantly better and by at least ``LEAST_REDUCTION``. Only
    series that need the interval are resampled.
    """
    tested = diebold_mariano(df, keys=keys, order=order, loss_a=loss_a, loss_b=loss_b, horizon=horizon)
    tested = tested.withColumn("method", F.when((F.col("errors") >= LEAST_ERRORS) & F.col("statistic").isNotNull(), "DIEBOLD_MARIANO").otherwise("BLOCK_BOOTSTRAP"))
    tested = materialize(tested, "loss_tests")  # one row a series, read twice
    short = tested.where(F.col("method") == "BLOCK_BOOTSTRAP").select(*keys)
    rows = df.withColumn("_d", (loss_a - loss_b).cast("double")).where("_d IS NOT NULL").join(short, list(keys), "left_semi")
    cut = blocks(rows, keys=keys, order=order, length=block, out="_block")
    interval = ratio_interval(cut, keys=keys, unit=["_block"], numerator=F.col("_d"), plan=plan).select(*keys, "units", "lower", "upper")
    out = tested.join(interval, list(keys), "left").withColumn("reduction", safe_ratio(F.col("difference"), F.col("mean_a")))
    better = F.when(F.col("method") == "DIEBOLD_MARIANO", (F.col("p_value") < ALPHA) & (F.col("statistic") > 0)).otherwise(F.coalesce(F.col("lower") > 0, F.lit(False)))
    return out.withColumn("accepted", F.coalesce(better & (F.col("reduction") >= LEAST_REDUCTION), F.lit(False)))


# ---- discrimination ----------------------------------------------------------


def _placements(cells: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """For every value of a score: the share of the other class that a positive, or a negative, of that value beats."""
    run = running_by_value(cells, keys, score, {"p": F.when(F.col("y") == 1, F.col("n")).otherwise(0), "q": F.when(F.col("y") == 0, F.col("n")).otherwise(0)})
    above = F.col("p_total") - F.col("p_before") - F.col("p")
    return run.select(
        *keys,
        score,
        safe_ratio(F.col("q_before") + F.col("q") / 2.0, F.col("q_total")).alias(f"_v1_{score}"),
        safe_ratio(above + F.col("p") / 2.0, F.col("p_total")).alias(f"_v0_{score}"),
    )


def delong(df: DataFrame, *, keys: Sequence[str], truth: str, scores: Sequence[str]) -> DataFrame:
    """Differences between the ROC areas of the last score and of each other one, on the same rows.

    ``(keys, score, against, auc, auc_against, difference, variance, statistic,
    p_value, positives, negatives, usable)``: ``usable`` needs ``LEAST_EVENTS`` of
    each class. Rows collapse to distinct (truth, scores) before anything is
    joined, so a value that many rows share is one row; rows with a null do not count.
    """
    names = [f"s{i}" for i in range(len(scores))]
    rows = df.select(*keys, F.col(truth).cast("int").alias("y"), *[F.col(c).cast("double").alias(n) for c, n in zip(scores, names, strict=True)])
    rows = rows.where(F.col("y").isin(0, 1)).na.drop(subset=names)
    cells = materialize(rows.groupBy(*keys, "y", *names).agg(F.count(F.lit(1)).alias("n")), "score_cells")
    met = cells
    for s in names:
        met = met.join(_placements(cells, keys, s), [*keys, s])
    value = {s: F.when(F.col("y") == 1, F.col(f"_v1_{s}")).otherwise(F.col(f"_v0_{s}")) - 0.5 for s in names}
    last = names[-1]
    n = F.col("n")
    sums = [F.sum(n).alias("n"), *[F.sum(n * value[s]).alias(f"m_{s}") for s in names], *[F.sum(n * value[s] * value[s]).alias(f"c_{s}") for s in names]]
    sums += [F.sum(n * value[s] * value[last]).alias(f"x_{s}") for s in names[:-1]]
    both = met.groupBy(*keys, "y").agg(*sums)
    n = F.col("n")

    def spread(s: str) -> Column:
        """Variance of the mean of the differences between two placements within a class."""
        square = F.col(f"c_{s}") + F.col(f"c_{last}") - 2 * F.col(f"x_{s}")
        first = F.col(f"m_{s}") - F.col(f"m_{last}")
        return F.when(n > 1, (square - first * first / n) / (n - 1) / n)

    listed = F.array(*[F.struct(F.lit(c).alias("against"), (F.col(f"m_{s}") / n + 0.5).alias("a"), spread(s).alias("v")) for c, s in zip(scores, names, strict=True) if s != last])
    long = both.select(*keys, "y", "n", (F.col(f"m_{last}") / n + 0.5).alias("auc"), F.explode(listed).alias("o"))
    pick = lambda column, y: F.max(F.when(F.col("y") == y, column))
    flat = long.groupBy(*keys, F.col("o.against").alias("against")).agg(
        pick(F.col("auc"), 1).alias("auc"),
        pick(F.col("o.a"), 1).alias("auc_against"),
        (pick(F.col("o.v"), 1) + pick(F.col("o.v"), 0)).alias("variance"),
        F.coalesce(pick(F.col("n"), 1), F.lit(0)).alias("positives"),
        F.coalesce(pick(F.col("n"), 0), F.lit(0)).alias("negatives"),
    )
    difference = F.col("auc") - F.col("auc_against")
    flat = flat.withColumns({"score": F.lit(scores[-1]), "difference": difference, "statistic": F.when(F.col("variance") > 1e-15, difference / F.sqrt("variance"))})
    usable = (F.col("positives") >= LEAST_EVENTS) & (F.col("negatives") >= LEAST_EVENTS)
    out = flat.withColumns({"p_value": F.when(F.col("statistic").isNotNull(), normal_two_sided(F.col("statistic"))), "usable": usable})
    return out.select(*keys, "score", "against", "auc", "auc_against", "difference", "variance", "statistic", "p_value", "positives", "negatives", "usable")


# ---- utility -----------------------------------------------------------------


def utility_by_threshold(
    df: DataFrame, *, keys: Sequence[str], truth: str, score: str, benefit: float, false_alarm: float, miss: float, model_cost: float = 0.0
) -> DataFrame:
    """Net economic effect of alarming at or above every score that occurs.

    Benefit of every event found, less the cost of false alarms and of missed
    events and the cost of the model. One pass over pieces of the score axis.
    """
    run = running_by_value(df, keys, score, {"p": (F.col(truth) == 1).cast("long"), "q": (F.col(truth) == 0).cast("long")})
    found, wrong = F.col("p_total") - F.col("p_before"), F.col("q_total") - F.col("q_before")
    effect = benefit * found - false_alarm * wrong - miss * F.col("p_before") - model_cost
    return run.select(*keys, F.col(score).alias("threshold"), found.alias("found"), wrong.alias("false_alarms"), F.col("p_before").alias("missed"), effect.alias("net_effect"))


def best_threshold(by_threshold: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """The threshold with the largest net effect; among equal ones the highest, which alarms least."""
    rest = [c for c in by_threshold.columns if c not in (*keys, "net_effect", "threshold")]
    best = by_threshold.groupBy(*keys).agg(F.max(F.struct("net_effect", "threshold", *rest)).alias("b"))
    return best.select(*keys, "b.*")


def net_effect_interval(
    df: DataFrame, thresholds: DataFrame, *, keys: Sequence[str], unit: Sequence[str], truth: str, score: str, benefit: float, false_alarm: float,
    miss: float, model_cost: float = 0.0, plan: Resampling = Resampling(),
) -> DataFrame:
    """Net effect per unit at thresholds frozen before (keys, threshold), with its interval over resampled units.

    The cost of the model is spread over the units. ``accepted``: the lower end is above zero.
    """
    alarm, event = F.col(score) >= F.col("threshold"), F.col(truth) == 1
    effect = F.when(alarm & event, benefit).when(alarm, -false_alarm).when(event, -miss).otherwise(0.0)
    judged = df.join(thresholds.select(*keys, "threshold"), list(keys)).withColumn("_e", effect)
    units = judged.groupBy(*keys, *unit).agg(F.sum("_e").alias("_e"))
    counted = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = units.join(counted, list(keys)).withColumn("_e", F.col("_e") - model_cost / F.col("_n"))
    out = ratio_interval(share, keys=keys, unit=unit, numerator=F.col("_e"), plan=plan)
    return out.withColumn("accepted", F.coalesce(F.col("lower") > 0, F.lit(False)))
