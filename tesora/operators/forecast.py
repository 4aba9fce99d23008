"""Rolling-origin baselines, their error metrics, rankings and backtest folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import safe_ratio
from tesora.operators.contracts import require_unique

# Baseline columns and the names they are reported under.
BASELINES = {
    "last_value": "Last Value",
    "seasonal_naive": "Seasonal Naive",
    "linear_trend": "Linear Trend",
}
METRICS = ("mae", "r2", "wape", "rmse", "mase")


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key: the one with the highest sequence. Collapses before the shuffle."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(seq)).alias("row"))
    return picked.select("row.*")


def rolling_origin(
    df: DataFrame,
    *,
    keys: Sequence[str],
    period: str = "period",
    value: str = "value",
    min_train: int = 12,
    seasonality: int = 12,
    unique: bool = False,
) -> DataFrame:
    """Every row with its position and the three one-step forecasts from earlier rows.

    Forecast rows are those with ``pos >= min_train``; the earlier ones stay
    because the scaled error needs them.
    """
    data = df.select(*keys, F.col(period).cast("date").alias(period), F.col(value).cast("double").alias("actual"))
    if not unique:
        data = require_unique(data, [*keys, period], "series period repeats")
    by = Window.partitionBy(*keys).orderBy(period)
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    scale_lag = seasonality if min_train > seasonality else 1
    y = F.col("actual")
    data = data.withColumn("pos", F.row_number().over(by) - 1)
    slope = F.regr_slope(y, F.col("pos")).over(past)
    intercept = F.regr_intercept(y, F.col("pos")).over(past)
    return data.select(
        "*",
        F.lag(y, 1).over(by).alias("last_value"),
        F.coalesce(F.lag(y, seasonality).over(by), F.lag(y, 1).over(by)).alias("seasonal_naive"),
        F.coalesce(intercept + slope * F.col("pos"), F.lag(y, 1).over(by)).alias("linear_trend"),
        F.when(F.col("pos") < min_train, F.abs(y - F.lag(y, scale_lag).over(by))).alias("scale_term"),
    )


def baseline_forecasts(df: DataFrame, *, min_train: int = 12, **kw) -> DataFrame:
    """Forecast table: actual and the three baselines from ``min_train`` on."""
    table = rolling_origin(df, min_train=min_train, **kw)
    return table.where(F.col("pos") >= min_train).drop("pos", "scale_term")


def _error_terms(actual: Column, predicted: Column, use: Column) -> dict[str, Column]:
    err = F.when(use, actual - predicted)
    return {"ae": F.sum(F.abs(err)), "se": F.sum(err * err), "n": F.count(err)}


def _metric_columns(ae: Column, se: Column, n: Column, sst: Column, abs_actual: Column, scale: Column) -> list[Column]:
    mae = safe_ratio(ae, n)
    return [
        n.alias("observations"),
        mae.alias("mae"),
        (1.0 - safe_ratio(se, sst)).alias("r2"),
        safe_ratio(ae, abs_actual).alias("wape"),
        F.sqrt(safe_ratio(se, n)).alias("rmse"),
        safe_ratio(mae, scale).alias("mase"),
    ]


def baseline_metrics(
    table: DataFrame, *, keys: Sequence[str], min_train: int = 12, period: str = "period", holdout_year: int | None = None
) -> DataFrame:
    """MAE, R2, WAPE, RMSE and MASE per series and baseline.

    ``table`` comes from :func:`rolling_origin`; it is already clustered by the
    series, so this aggregate adds no shuffle.
    """
    use = F.col("pos") >= min_train
    if holdout_year is not None:
        use = use & (F.year(period) == holdout_year)
    actual = F.when(use, F.col("actual"))
    aggs = [
        F.avg("scale_term").alias("scale"),
        (F.var_pop(actual) * F.count(actual)).alias("sst"),
        F.sum(F.abs(actual)).alias("abs_actual"),
    ]
    for m in BASELINES:
        aggs += [c.alias(f"{m}_{k}") for k, c in _error_terms(F.col("actual"), F.col(m), use).items()]
    flat = table.groupBy(*keys).agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(label).alias("model"), *[F.col(f"{m}_{k}").alias(k) for k in ("ae", "se", "n")])
                for m, label in BASELINES.items()
            ]
        )
    )
    long = flat.select(*keys, "scale", "sst", "abs_actual", rows.alias("m")).where(F.col("m.n") > 0)
    return long.select(
        *keys,
        F.col("m.model").alias("model"),
        *_metric_columns(*[F.col(c) for c in ("m.ae", "m.se", "m.n", "sst", "abs_actual", "scale")]),
    )


def rank_models(metrics: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Order by MAE, RMSE and name within a series. One row per model, so groups are tiny."""
    by = Window.partitionBy(*keys).orderBy("mae", "rmse", "model")
    return metrics.withColumn("rank_mae", F.row_number().over(by))


def tournament(
    df: DataFrame,
    *,
    keys: Sequence[str],
    period: str = "period",
    value: str = "value",
    min_train: int = 12,
    seasonality: int = 12,
    holdout_year: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Ranked baseline metrics of every series at once."""
    data = df
    if holdout_year is not None:
        data = data.where(F.year(F.col(period).cast("date")) <= holdout_year)
    table = rolling_origin(
        data, keys=keys, period=period, value=value, min_train=min_train, seasonality=seasonality, unique=unique
    )
    metrics = baseline_metrics(table, keys=keys, min_train=min_train, period=period, holdout_year=holdout_year)
    return rank_models(metrics, keys=keys)


def champions(metrics: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Smallest error per key; ties break by RMSE, then name."""
    order = ["mae", "rmse", "model"]
    rest = [c for c in metrics.columns if c not in (*keys, *order)]
    best = metrics.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, "best.*")


def leader_improvement(metrics: DataFrame, *, keys: Sequence[str], against: str) -> DataFrame:
    """Leader and its relative MAE improvement over a named model."""
    known = metrics.where(F.col("mae").isNotNull())
    flat = known.groupBy(*keys).agg(
        F.min(F.struct("mae", "model")).alias("lead"), F.max(F.when(F.col("model") == against, F.col("mae"))).alias("other")
    )
    return flat.select(
        *keys,
        F.col("lead.model").alias("leader"),
        F.col("lead.mae").alias("leader_mae"),
        safe_ratio(F.col("other") - F.col("lead.mae"), F.col("other")).alias("improvement"),
    )


def score_forecasts(
    forecasts: DataFrame,
    history: DataFrame,
    *,
    keys: Sequence[str],
    actual: str = "actual",
    predicted: str = "predicted",
    period: str = "period",
    value: str = "value",
) -> DataFrame:
    """Metrics of outside forecasts; the MASE scale is the mean absolute step of the history."""
    by = Window.partitionBy(*keys).orderBy(period)
    steps = history.select(*keys, F.abs(F.col(value) - F.lag(value, 1).over(by)).alias("step"))
    scale = steps.groupBy(*keys).agg(F.avg("step").alias("scale"))
    a = F.col(actual)
    sums = forecasts.groupBy(*keys).agg(
        *[c.alias(k) for k, c in _error_terms(a, F.col(predicted), F.lit(True)).items()],
        (F.var_pop(a) * F.count(a)).alias("sst"),
        F.sum(F.abs(a)).alias("abs_actual"),
    )
    joined = sums.join(scale, list(keys), "left")
    return joined.select(*keys, *_metric_columns(*[F.col(c) for c in ("ae", "se", "n", "sst", "abs_actual", "scale")]))


def compare_forecasts(left: DataFrame, right: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Two models' forecasts side by side; periods of either are kept."""
    return left.join(right, list(keys), "full_outer")


def expanding_folds(
    lengths: DataFrame,
    *,
    n: str = "n_periods",
    min_train: int = 24,
    horizon: int = 1,
    holdout: int = 12,
    step: int = 1,
) -> DataFrame:
    """Development folds per series length, with the locked final holdout.

    Lengths too short for one fold give no rows; :func:`too_short` lists them.
    """
    if min(min_train, horizon, holdout, step) < 1:
        raise ValueError("min_train, horizon, holdout and step must be >= 1")
    last = F.col(n) - holdout - horizon
    ok = lengths.where(F.col(n) >= min_train + horizon + holdout)
    ends = F.explode(F.sequence(F.lit(min_train), last.cast("int"), F.lit(step)))
    rows = ok.select("*", ends.alias("train_end"))
    return rows.withColumns(
        {
            "train_start": F.lit(0),
            "test_start": F.col("train_end"),
            "test_end": F.col("train_end") + horizon,
            "holdout_start": (F.col(n) - holdout).cast("int"),
            "holdout_end": F.col(n).cast("int"),
        }
    )


def too_short(lengths: DataFrame, *, n: str = "n_periods", min_train=24, horizon=1, holdout=12) -> DataFrame:
    return lengths.where(F.col(n) < min_train + horizon + holdout)


def fold_sums(
    panel: DataFrame, folds: DataFrame, *, keys: Sequence[str], period: str, value: str
) -> DataFrame:
    """Rows and total of the TRAIN and the TEST part of every fold, ``(keys, train_end, test_end, part, n_rows, total)``.

    Sums along each series are taken once; a fold needs the two at its ends, so
    no row is paired with the folds it belongs to. ``folds`` start at the first
    period, as :func:`expanding_folds` makes them.
    """
    by = Window.partitionBy(*keys).orderBy(period)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = panel.select(*keys, (F.row_number().over(by) - 1).alias("_pos"), F.sum(value).over(upto).alias("_sum"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), (F.col("train_end") - 1).alias("at")), F.struct(F.lit(1).alias("end"), (F.col("test_end") - 1).alias("at"))))
    cuts = folds.select(*keys, "train_end", "test_end", ends.alias("_cut"))
    met = cuts.join(rows.withColumnRenamed("_pos", "_at"), [*[cuts[k] == rows[k] for k in keys], F.col("_cut.at") == F.col("_at")])
    met = met.select(*[cuts[k] for k in keys], "train_end", "test_end", F.col("_cut.end").alias("_end"), "_sum")
    both = met.groupBy(*keys, "train_end", "test_end").agg(
        F.max(F.when(F.col("_end") == 0, F.col("_sum"))).alias("_train"), F.max(F.when(F.col("_end") == 1, F.col("_sum"))).alias("_all")
    )
    part = lambda name, n, total: F.struct(F.lit(name).alias("part"), n.cast("long").alias("n_rows"), total.alias("total"))
    train = part("TRAIN", F.col("train_end"), F.col("_train"))
    test = part("TEST", F.col("test_end") - F.col("train_end"), F.col("_all") - F.col("_train"))
    return both.select(*keys, "train_end", "test_end", F.inline(F.array(train, test)))
