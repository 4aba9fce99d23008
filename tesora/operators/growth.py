"""Global growth model with a rolling origin: boosted trees on the log growth of all series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import from_log_growth
from tesora.operators.panel import growth_features
from tesora.session import materialize

NUMERIC = (
    "month",
    "month_sin",
    "month_cos",
    "lag_1",
    "lag_2",
    "lag_3",
    "lag_6",
    "lag_12",
    "rolling_mean_3",
    "rolling_std_3",
    "rolling_mean_6",
    "rolling_std_6",
    "lag1_delta",
    "lag1_pct",
    "yoy_lag",
)
MISSING = -1.0e12
#: Bins of a feature; a nominal one may have as many values, less one for values not seen in training.
BINS = 64
#: Rows of the overall mean that a key's own mean is blended with.
PRIOR_ROWS = 10.0


def ordered_statistic(data: DataFrame, key: str, *, period: str, label: str, out: str, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """Mean label of a key's rows in strictly earlier periods, blended with that of all keys; null in the first period.

    A row never sees labels of its own or a later period. Labels are summed per
    key and period before any window, so a key has one row a period there; the
    overall mean has one row a period.
    """
    sums = data.where(F.col(label).isNotNull()).groupBy(key, period).agg(F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_n"))
    held = data.select(key, period).distinct().join(sums, [key, period], "left")
    earlier = lambda by: by.orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    own = held.select(key, period, *[F.coalesce(F.sum(c).over(earlier(Window.partitionBy(key))), F.lit(0.0)).alias(f"{c}_own") for c in ("_s", "_n")])
    whole = held.groupBy(period).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))  # one row a period of the calendar
    whole = whole.select(period, *[F.sum(c).over(earlier(Window.partitionBy())).alias(f"{c}_all") for c in ("_s", "_n")])
    prior = F.col("_s_all") / F.col("_n_all")
    value = (F.col("_s_own") + prior_rows * prior) / (F.col("_n_own") + prior_rows)
    return data.join(own.join(whole, period).select(key, period, value.alias(out)), [key, period])


def rolling_growth_forecast(
    panel: DataFrame,
    *,
    holdout_year: int,
    keys: Sequence[str] = ("oktmo", "category_code"),
    period: str = "period_start",
    value: str = "spending_nominal",
    iterations: int = 120,
    depth: int = 4,
    learning_rate: float = 0.05,
    seed: int = 42,
    unique: bool = False,
    parallelism: int = 4,
    nominal: Sequence[str] = ("category_code",),
) -> DataFrame:
    """Forecast of every series for each month of the holdout year.

    For each month a model is fitted on all earlier rows of all series. The
    features are written once; at most twelve fits, ``parallelism`` of them at a
    time, and the scoring read them. A key in ``nominal`` has few values and is
    an exact nominal feature; having more than ``BINS`` - 1 is an error. Any
    other key, such as the territory, enters as the mean growth of its earlier
    rows (:func:`ordered_statistic`), so no list of territories exists anywhere.
    The driver sees the values of nominal keys and the holdout months.
    """
    data = growth_features(panel, keys=keys, period=period, value=value, unique=unique)
    data = data.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in NUMERIC if c != "lag_1"})
    rest = [k for k in keys if k not in nominal]
    data = data.where(F.col("lag_1").isNotNull())
    for k in rest:
        data = ordered_statistic(data, k, period=period, label="growth", out=f"_{k}_mean")
    data = materialize(data.withColumns({f"_{k}_mean": F.coalesce(f"_{k}_mean", F.lit(MISSING)) for k in rest}), "growth_features")
    own = [k for k in keys if k in nominal]
    found = data.agg(*[F.approx_count_distinct(k, 0.01).alias(k) for k in own]).first() if own else {}
    wide = [k for k in own if found[k] >= BINS]
    if wide:
        raise ValueError(f"too many values for a nominal feature: {', '.join(wide)}")
    numbered = {k: f"_{k}_index" for k in own}
    index = StringIndexer(inputCols=list(numbered), outputCols=list(numbered.values()), handleInvalid="keep", stringOrderType="alphabetAsc")
    data = index.fit(data).transform(data) if own else data
    months = [r[0] for r in data.where(F.year(period) == holdout_year).select(period).distinct().orderBy(period).collect()]
    if not months:
        raise ValueError(f"no observations in holdout year {holdout_year}")
    assemble = VectorAssembler(inputCols=[*numbered.values(), *[f"_{k}_mean" for k in rest], *NUMERIC], outputCol="features", handleInvalid="keep")

    def forecast(month) -> DataFrame:
        trees = GBTRegressor(
            featuresCol="features",
            labelCol="growth",
            predictionCol="predicted_growth",
            lossType="absolute",
            maxIter=iterations,
            maxDepth=depth,
            stepSize=learning_rate,
            maxBins=BINS,
            seed=seed,
        )
        train = data.where((F.col(period) < F.lit(month)) & F.col("growth").isNotNull())
        rows = Pipeline(stages=[assemble, trees]).fit(train).transform(data.where(F.col(period) == F.lit(month)))
        return rows.select(
            *keys, period, F.col(value).alias("actual"), from_log_growth("lag_1", "predicted_growth").alias("grow_prediction")
        )

    with ThreadPool(max(1, min(parallelism, len(months)))) as pool:
        return reduce(DataFrame.unionByName, pool.map(forecast, months))
