"""Leakage-free features of a period panel.

A panel has one row per series and period. That uniqueness bounds every series
by the calendar (a century of months is 1,200 rows), so windows partitioned by
series stay small however many facts were summed into the panel; parallelism is
the number of series. Every column of one matrix shares one window, hence one
shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import calendar_features, from_log_growth, log_growth, safe_ratio
from tesora.operators.contracts import Split, require_unique

PANEL_KEYS = ("oktmo", "category_code")
DEFAULT_LAGS = (1, 2, 3, 6, 12)
DEFAULT_WINDOWS = (3, 6)
RESOLVED = "OKTMO_RESOLVED"


def eligible(df: DataFrame) -> DataFrame:
    """Rows cleared for modelling, where the table says so."""
    if "model_eligible" in df.columns:
        df = df.where(F.col("model_eligible").cast("boolean"))
    if "identity_status" in df.columns:
        df = df.where(F.col("identity_status") == RESOLVED)
    return df


def _ordered_features(
    df: DataFrame,
    keys: Sequence[str],
    period: str,
    target: str,
    lags: Sequence[int],
    windows: Sequence[int],
) -> DataFrame:
    if any(k <= 0 for k in (*lags, *windows)):
        raise ValueError("lags and rolling windows must be positive")
    by = Window.partitionBy(*keys).orderBy(period)
    y = F.col(target)
    added = {"history_points": F.row_number().over(by) - 1}
    added |= {f"lag_{k}": F.lag(y, k).over(by) for k in lags}
    for k in windows:
        frame = by.rowsBetween(-k, -1)
        added[f"rolling_mean_{k}"] = F.avg(y).over(frame)
        added[f"rolling_std_{k}"] = F.stddev_samp(y).over(frame)
    return df.withColumns(added)


def consumption_matrix(
    df: DataFrame,
    *,
    categories: Sequence[str] | None = None,
    lags: Sequence[int] = DEFAULT_LAGS,
    windows: Sequence[int] = DEFAULT_WINDOWS,
    keys: Sequence[str] = PANEL_KEYS,
    period: str = "period_start",
    value: str = "spending_nominal",
    unique: bool = False,
) -> DataFrame:
    """Target, calendar parts, lags and rolling statistics of earlier rows.

    ``unique=True`` skips the duplicate check for a panel that was just grouped
    by its key.
    """
    data = eligible(df)
    if categories is not None:
        data = data.where(F.col(keys[-1]).isin(*[str(c) for c in categories]))
    data = data.withColumn(period, F.col(period).cast("date")).withColumn(value, F.col(value).cast("double"))
    if not unique:
        data = require_unique(data, [*keys, period], "panel key repeats")
    data = data.withColumn("target", F.col(value)).withColumns(calendar_features(period))
    data = _ordered_features(data, keys, period, "target", lags, windows)
    if 1 in lags and 12 in lags:
        data = data.withColumn("yoy_change_lagged", safe_ratio("lag_1", "lag_12") - 1.0)
    return data


def growth_features(
    df: DataFrame,
    *,
    keys: Sequence[str] = PANEL_KEYS,
    period: str = "period_start",
    value: str = "spending_nominal",
    unique: bool = False,
) -> DataFrame:
    """Features of the growth model, and its target ``growth = ln(y / lag_1)``."""
    data = df if unique else require_unique(df, [*keys, period], "panel key repeats")
    parts = calendar_features(period)
    data = data.withColumns({k: parts[k] for k in ("month", "month_sin", "month_cos")})
    data = _ordered_features(data, keys, period, value, DEFAULT_LAGS, DEFAULT_WINDOWS)
    return data.withColumns(
        {
            "lag1_delta": F.col("lag_1") - F.col("lag_2"),
            "lag1_pct": safe_ratio("lag_1", "lag_2") - 1.0,
            "yoy_lag": safe_ratio("lag_1", "lag_12") - 1.0,
            "growth": log_growth(value, "lag_1"),
        }
    )


def growth_prediction(df: DataFrame, growth: str = "growth", lag1: str = "lag_1") -> DataFrame:
    return df.withColumn("prediction", from_log_growth(lag1, growth))


def fill_calendar(
    df: DataFrame, keys: Sequence[str], period: str = "period_start", value: str = "spending_nominal"
) -> DataFrame:
    """Opt-in: one row per month between a series' first and last month, gaps as NULL."""
    span = df.groupBy(*keys).agg(F.min(period).alias("_a"), F.max(period).alias("_b"))
    grid = span.select(*keys, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias(period))
    return grid.join(df.select(*keys, period, value), [*keys, period], "left")


def scope(df: DataFrame, *, target: str, prefix: str, code: str = "oktmo") -> tuple[DataFrame, DataFrame]:
    """Peers sharing a code prefix, and the target among them."""
    peers = eligible(df.withColumn(code, F.trim(F.col(code)))).where(F.col(code).startswith(prefix))
    return peers, peers.where(F.col(code) == target)


def holdout_split(df: DataFrame, *, holdout_year: int, period: str = "period_start") -> Split:
    """Rows before the holdout year, and rows in it (as ``clean`` and ``quarantine`` of the split)."""
    year = F.year(F.col(period).cast("date"))
    return Split(df.where(year < holdout_year), df.where(year == holdout_year))


def holdout_readiness(
    df: DataFrame, *, holdout_year: int, keys: Sequence[str] = PANEL_KEYS, period: str = "period_start"
) -> DataFrame:
    """Per series: training and holdout rows, and whether both sides exist."""
    year = F.year(F.col(period).cast("date"))
    counts = df.groupBy(*keys).agg(
        F.count_if(year < holdout_year).alias("train_rows"), F.count_if(year == holdout_year).alias("holdout_rows")
    )
    return counts.withColumn("ready", (F.col("train_rows") > 0) & (F.col("holdout_rows") > 0))


def series_readiness(df: DataFrame, keys: Sequence[str], min_points: int = 25) -> DataFrame:
    """Series with enough observations for a benchmark."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    return counts.withColumn("ready", F.col("points") >= min_points)
