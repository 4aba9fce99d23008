"""Queries on the monthly panel: features, baselines, tournaments and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesora.functions import scalar as S
from tesora.operators import forecast as fc
from tesora.operators import metrics as mt
from tesora.operators import panel as pn
from tesora.operators import resample as rs
from tesora.operators import significance as sg
from tesora.plans import inputs as data
from tesora.plans.registry import query, rounded, sql_round as r

KEYS = ["oktmo", "category_code"]
PERIOD = {"period": "period_start", "value": "spending_nominal"}


def _walk_sql(level: str, min_train: int, season: int, upto: int | None = None) -> str:
    """Positions and the three forecasts, written from their definitions."""
    where = f"WHERE year(period_start) <= {upto}" if upto else ""
    lag = season if min_train > season else 1
    return f"""{data.panel_sql(level)},
numbered AS (SELECT *, row_number() OVER (PARTITION BY oktmo, category_code ORDER BY period_start) - 1 AS pos FROM panel {where}),
walk AS (
  SELECT oktmo, category_code, period_start, pos, spending_nominal AS actual,
    lag(spending_nominal) OVER w AS last_value,
    coalesce(lag(spending_nominal, {season}) OVER w, lag(spending_nominal) OVER w) AS seasonal_naive,
    CASE WHEN pos < 2 THEN lag(spending_nominal) OVER w ELSE
      regr_intercept(spending_nominal, pos) OVER past + regr_slope(spending_nominal, pos) OVER past * pos END AS linear_trend,
    CASE WHEN pos < {min_train} THEN abs(spending_nominal - lag(spending_nominal, {lag}) OVER w) END AS scale_term
  FROM numbered
  WINDOW w AS (PARTITION BY oktmo, category_code ORDER BY period_start),
         past AS (PARTITION BY oktmo, category_code ORDER BY period_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _metrics_sql(min_train: int, holdout: int | None = None) -> str:
    used = f"pos >= {min_train}" + (f" AND year(period_start) = {holdout}" if holdout else "")
    models = (("last_value", "Last Value"), ("seasonal_naive", "Seasonal Naive"), ("linear_trend", "Linear Trend"))
    rows = "\n  UNION ALL ".join(
        f"SELECT oktmo, category_code, '{label}' AS model, actual, {c} AS predicted FROM walk WHERE {used}"
        for c, label in models
    )
    return f"""scored AS ({rows}),
scales AS (SELECT oktmo, category_code, avg(scale_term) AS scale FROM walk GROUP BY 1, 2),
metrics AS (
  SELECT oktmo, category_code, model, count(*) AS observations, avg(abs(actual - predicted)) AS mae,
    1 - sum((actual - predicted) ** 2) / nullif(var_pop(actual) * count(*), 0) AS r2,
    sum(abs(actual - predicted)) / nullif(sum(abs(actual)), 0) AS wape,
    sqrt(avg((actual - predicted) ** 2)) AS rmse,
    avg(abs(actual - predicted)) / nullif(any_value(scale), 0) AS mase
  FROM scored JOIN scales USING (oktmo, category_code) GROUP BY 1, 2, 3)"""


_RANKED = f"""SELECT oktmo, category_code, model, observations, {r("mae", 4)} AS mae, {r("r2", 7)} AS r2, {r("wape", 9)} AS wape,
  {r("rmse", 4)} AS rmse, {r("mase", 8)} AS mase,
  CAST(row_number() OVER (PARTITION BY oktmo, category_code ORDER BY metrics.mae, metrics.rmse, model) AS INTEGER) AS rank_mae
FROM metrics"""


def _ranked(df):
    return df.withColumns(
        {"mae": F.round("mae", 4), "r2": F.round("r2", 7), "wape": F.round("wape", 9), "rmse": F.round("rmse", 4), "mase": F.round("mase", 8)}
    )


@query("baseline_tournament", f"WITH {_walk_sql('region', 24, 12)}, {_metrics_sql(24)}\n{_RANKED}")
def baseline_tournament(spark, sf):
    return _ranked(
        fc.tournament(data.panel(spark, sf, "region"), keys=KEYS, **PERIOD, min_train=24, seasonality=12, unique=True)
    )


@query(
    "baseline_forecasts",
    f"""WITH {_walk_sql('nation', 24, 12)}
SELECT oktmo, category_code, period_start, actual, last_value, seasonal_naive, {r("linear_trend", 1)} AS linear_trend
FROM walk WHERE pos >= 24""",
)
def baseline_forecasts(spark, sf):
    table = fc.baseline_forecasts(data.panel(spark, sf, "nation"), keys=KEYS, **PERIOD, min_train=24, unique=True)
    return rounded(table, 1, "linear_trend")


@query("holdout_tournament", f"WITH {_walk_sql('nation', 12, 12, 2000)}, {_metrics_sql(12, 2000)}\n{_RANKED}")
def holdout_tournament(spark, sf):
    return _ranked(
        fc.tournament(
            data.panel(spark, sf, "nation"), keys=KEYS, **PERIOD, min_train=12, seasonality=12, holdout_year=2000, unique=True
        )
    )


@query(
    "champion_by_category",
    f"""WITH {_walk_sql('region', 12, 12, 2000)}, {_metrics_sql(12, 2000)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY oktmo, category_code ORDER BY mae, rmse, model) AS place FROM metrics)
SELECT oktmo, category_code, {r("mae", 4)} AS mae, {r("rmse", 4)} AS rmse, model, observations, {r("r2", 7)} AS r2,
  {r("wape", 9)} AS wape, {r("mase", 8)} AS mase
FROM ranked WHERE place = 1""",
)
def champion_by_category(spark, sf):
    ranked = fc.tournament(
        data.panel(spark, sf, "region"), keys=KEYS, **PERIOD, min_train=12, seasonality=12, holdout_year=2000, unique=True
    )
    return _ranked(fc.champions(ranked.drop("rank_mae"), keys=KEYS))


@query(
    "leader_improvement",
    f"""WITH {_walk_sql('region', 24, 12)}, {_metrics_sql(24)}
SELECT oktmo, category_code, arg_min(model, mae) AS leader, {r("min(mae)", 4)} AS leader_mae,
  {r("(max(CASE WHEN model = 'Seasonal Naive' THEN mae END) - min(mae)) / max(CASE WHEN model = 'Seasonal Naive' THEN mae END)", 8)} AS improvement
FROM metrics GROUP BY 1, 2""",
)
def leader_improvement(spark, sf):
    ranked = fc.tournament(data.panel(spark, sf, "region"), keys=KEYS, **PERIOD, min_train=24, seasonality=12, unique=True)
    out = fc.leader_improvement(ranked, keys=KEYS, against="Seasonal Naive")
    return out.withColumns({"leader_mae": F.round("leader_mae", 4), "improvement": F.round("improvement", 8)})


_LAGS = ", ".join(f"lag(spending_nominal, {k}) OVER w AS lag_{k}" for k in (1, 2, 3, 6, 12))
_ROLL = ", ".join(
    f"avg(spending_nominal) OVER (PARTITION BY oktmo, category_code ORDER BY period_start ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS rolling_mean_{k}, "
    f"stddev_samp(spending_nominal) OVER (PARTITION BY oktmo, category_code ORDER BY period_start ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS rolling_std_{k}"
    for k in (3, 6)
)
_WINDOW = "WINDOW w AS (PARTITION BY oktmo, category_code ORDER BY period_start)"
_ROLL_OUT = ", ".join(f"{r(f'rolling_{s}_{k}', 4)} AS rolling_{s}_{k}" for k in (3, 6) for s in ("mean", "std"))


@query(
    "lag_feature_matrix",
    f"""WITH {data.panel_sql('nation')},
m AS (SELECT *, row_number() OVER w - 1 AS history_points, {_LAGS}, {_ROLL} FROM panel {_WINDOW})
SELECT oktmo, category_code, period_start, spending_nominal, spending_nominal AS target,
  CAST(month(period_start) AS INTEGER) AS month, CAST(quarter(period_start) AS INTEGER) AS quarter, CAST(year(period_start) AS INTEGER) AS year,
  {r("sin(2 * pi() * month(period_start) / 12)", 9)} AS month_sin, {r("cos(2 * pi() * month(period_start) / 12)", 9)} AS month_cos,
  CAST(history_points AS INTEGER) AS history_points, lag_1, lag_2, lag_3, lag_6, lag_12, {_ROLL_OUT},
  {r("lag_1 / nullif(lag_12, 0) - 1", 9)} AS yoy_change_lagged
FROM m""",
)
def lag_feature_matrix(spark, sf):
    df = pn.consumption_matrix(data.panel(spark, sf, "nation"), unique=True)
    df = rounded(df, 4, *[f"rolling_{s}_{k}" for k in (3, 6) for s in ("mean", "std")])
    return rounded(df, 9, "month_sin", "month_cos", "yoy_change_lagged")


@query(
    "growth_features",
    f"""WITH {data.panel_sql('region')},
m AS (SELECT *, row_number() OVER w - 1 AS history_points, {_LAGS}, {_ROLL} FROM panel {_WINDOW})
SELECT oktmo, category_code, period_start, CAST(month(period_start) AS INTEGER) AS month, lag_1, lag_12, {_ROLL_OUT},
  {r("lag_1 - lag_2", 2)} AS lag1_delta, {r("lag_1 / nullif(lag_2, 0) - 1", 9)} AS lag1_pct,
  {r("lag_1 / nullif(lag_12, 0) - 1", 9)} AS yoy_lag, {r("ln(spending_nominal / lag_1)", 9)} AS growth
FROM m""",
)
def growth_features(spark, sf):
    df = pn.growth_features(data.panel(spark, sf, "region"), unique=True)
    df = rounded(df, 4, *[f"rolling_{s}_{k}" for k in (3, 6) for s in ("mean", "std")])
    df = rounded(df, 2, "lag1_delta")
    df = rounded(df, 9, "lag1_pct", "yoy_lag", "growth")
    return df.drop("spending_nominal", "month_sin", "month_cos", "history_points", "lag_2", "lag_3", "lag_6")


@query(
    "growth_inversion",
    f"""WITH {data.panel_sql('region')},
m AS (SELECT *, lag(spending_nominal) OVER w AS lag_1 FROM panel {_WINDOW})
SELECT oktmo, category_code, period_start, {r("lag_1 * exp(ln(spending_nominal / lag_1))", 2)} AS prediction FROM m WHERE lag_1 > 0""",
)
def growth_inversion(spark, sf):
    df = pn.growth_features(data.panel(spark, sf, "region"), unique=True).where(F.col("growth").isNotNull())
    return pn.growth_prediction(df).select("oktmo", "category_code", "period_start", F.round("prediction", 2).alias("prediction"))


@query(
    "holdout_readiness",
    f"""WITH {data.panel_sql('nation')}
SELECT oktmo, category_code, count(*) FILTER (year(period_start) < 2000) AS train_rows,
  count(*) FILTER (year(period_start) = 2000) AS holdout_rows,
  count(*) FILTER (year(period_start) < 2000) > 0 AND count(*) FILTER (year(period_start) = 2000) > 0 AS ready
FROM panel GROUP BY 1, 2""",
)
def holdout_readiness(spark, sf):
    return pn.holdout_readiness(data.panel(spark, sf, "nation"), holdout_year=2000)


@query(
    "peer_scope",
    f"""WITH {data.panel_sql('nation')}
SELECT oktmo, oktmo = 'NATION_1' AS is_target, year(period_start) < 2000 AS in_training, count(*) AS n_rows,
  {r("sum(spending_nominal)", 2)} AS spent
FROM panel WHERE oktmo LIKE 'NATION_1%' AND year(period_start) <= 2000 GROUP BY ALL""",
)
def peer_scope(spark, sf):
    peers, target = pn.scope(data.panel(spark, sf, "nation"), target="NATION_1", prefix="NATION_1")
    parts = pn.holdout_split(peers, holdout_year=2000)
    both = parts.clean.withColumn("in_training", F.lit(True)).unionByName(parts.quarantine.withColumn("in_training", F.lit(False)))
    marks = target.select("oktmo").distinct().withColumn("_t", F.lit(True))
    return (
        both.join(marks, "oktmo", "left")
        .groupBy("oktmo", F.coalesce("_t", F.lit(False)).alias("is_target"), "in_training")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("spending_nominal"), 2).alias("spent"))
    )


@query(
    "series_readiness",
    f"""WITH {data.EXTERNAL_SQL}
SELECT geography_name, variable, count(*) AS points, count(*) >= 25 AS ready FROM ext GROUP BY 1, 2""",
)
def series_readiness(spark, sf):
    df = data.external(spark, sf).withColumn("geography_name", F.trim("geography_name"))
    return pn.series_readiness(df, ["geography_name", "variable"])


@query(
    "calendar_gaps",
    f"""WITH {data.panel_sql('nation')},
span AS (SELECT oktmo, category_code, min(period_start) AS a, max(period_start) AS b FROM panel GROUP BY 1, 2),
grid AS (SELECT oktmo, category_code, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS period_start FROM span)
SELECT oktmo, category_code, count(*) AS months, count(*) - count(spending_nominal) AS gaps
FROM grid LEFT JOIN panel USING (oktmo, category_code, period_start) GROUP BY 1, 2""",
)
def calendar_gaps(spark, sf):
    filled = pn.fill_calendar(data.panel(spark, sf, "nation"), KEYS)
    return filled.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("months"), (F.count(F.lit(1)) - F.count("spending_nominal")).alias("gaps")
    )


@query(
    "forecast_scores",
    f"""WITH {_walk_sql('nation', 12, 12)},
hist AS (SELECT oktmo, category_code, avg(step) AS scale FROM (
  SELECT oktmo, category_code, abs(spending_nominal - lag(spending_nominal) OVER w) AS step FROM panel
  WHERE year(period_start) < 2000 {_WINDOW}) GROUP BY 1, 2),
f AS (SELECT oktmo, category_code, actual, seasonal_naive AS predicted FROM walk WHERE year(period_start) = 2000)
SELECT oktmo, category_code, count(*) AS observations, {r("avg(abs(actual - predicted))", 5)} AS mae,
  {r("1 - sum((actual - predicted) ** 2) / nullif(var_pop(actual) * count(*), 0)", 6)} AS r2,
  {r("sum(abs(actual - predicted)) / sum(abs(actual))", 9)} AS wape, {r("sqrt(avg((actual - predicted) ** 2))", 4)} AS rmse,
  {r("avg(abs(actual - predicted)) / any_value(scale)", 8)} AS mase
FROM f JOIN hist USING (oktmo, category_code) GROUP BY 1, 2""",
)
def forecast_scores(spark, sf):
    panel = data.panel(spark, sf, "nation")
    table = fc.rolling_origin(panel, keys=KEYS, **PERIOD, min_train=12, unique=True)
    outside = table.where(F.year("period_start") == 2000).withColumnRenamed("seasonal_naive", "predicted")
    history = panel.where(F.year("period_start") < 2000)
    out = fc.score_forecasts(outside, history, keys=KEYS, **PERIOD)
    return out.withColumns(
        {"mae": F.round("mae", 5), "r2": F.round("r2", 6), "wape": F.round("wape", 9), "rmse": F.round("rmse", 4), "mase": F.round("mase", 8)}
    )


@query(
    "forecast_comparison",
    f"""WITH {_walk_sql('nation', 12, 12)},
a AS (SELECT oktmo, category_code, period_start, last_value FROM walk WHERE pos >= 12),
b AS (SELECT oktmo, category_code, period_start, seasonal_naive FROM walk WHERE pos >= 24 OR pos < 12)
SELECT oktmo, category_code, period_start, last_value, seasonal_naive FROM a FULL JOIN b USING (oktmo, category_code, period_start)""",
)
def forecast_comparison(spark, sf):
    table = fc.rolling_origin(data.panel(spark, sf, "nation"), keys=KEYS, **PERIOD, min_train=12, unique=True)
    on = [*KEYS, "period_start"]
    left = table.where(F.col("pos") >= 12).select(*on, "last_value")
    right = table.where((F.col("pos") >= 24) | (F.col("pos") < 12)).select(*on, "seasonal_naive")
    return fc.compare_forecasts(left, right, keys=on)


@query(
    "expanding_folds",
    f"""WITH {data.panel_sql('nation')}, n AS (SELECT oktmo, category_code, count(*) AS n_periods FROM panel GROUP BY 1, 2)
SELECT oktmo, category_code, n_periods, 0 AS train_start, e AS train_end, e AS test_start, e + 1 AS test_end,
  CAST(n_periods - 12 AS INTEGER) AS holdout_start, CAST(n_periods AS INTEGER) AS holdout_end
FROM (SELECT *, CAST(unnest(generate_series(24, n_periods - 13, 3)) AS INTEGER) AS e FROM n WHERE n_periods >= 37)""",
)
def expanding_folds(spark, sf):
    lengths = data.panel(spark, sf, "nation").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_periods"))
    return fc.expanding_folds(lengths, min_train=24, horizon=1, holdout=12, step=3)


@query(
    "fold_assignment",
    f"""WITH {data.panel_sql('region')},
p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY oktmo, category_code) AS n FROM panel {_WINDOW}),
f AS (SELECT DISTINCT oktmo, category_code, CAST(unnest(generate_series(24, n - 15, 6)) AS INTEGER) AS e FROM p WHERE n >= 39)
SELECT oktmo, category_code, e AS train_end, CASE WHEN pos < e THEN 'TRAIN' ELSE 'TEST' END AS part, count(*) AS n_rows,
  {r("sum(spending_nominal)", 2)} AS spent
FROM p JOIN f USING (oktmo, category_code) WHERE pos < e + 3 GROUP BY ALL""",
)
def fold_assignment(spark, sf):
    panel = data.panel(spark, sf, "region")
    lengths = panel.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_periods"))
    folds = fc.expanding_folds(lengths, min_train=24, horizon=3, holdout=12, step=6)
    out = fc.fold_sums(panel, folds, keys=KEYS, period="period_start", value="spending_nominal")
    return out.select(*KEYS, "train_end", "part", "n_rows", F.round("total", 2).alias("spent"))


@query(
    "forecast_residuals",
    f"""WITH {_walk_sql('nation', 24, 12)},
e AS (SELECT oktmo, category_code, period_start, actual - seasonal_naive AS residual FROM walk WHERE pos >= 24)
SELECT oktmo, category_code, period_start, {r("residual", 2)} AS residual,
  {r("residual / nullif(stddev_pop(residual) OVER (PARTITION BY oktmo, category_code), 0)", 8)} AS standardized_residual
FROM e""",
)
def forecast_residuals(spark, sf):
    from pyspark.sql import Window

    table = fc.baseline_forecasts(data.panel(spark, sf, "nation"), keys=KEYS, **PERIOD, min_train=24, unique=True)
    table = table.withColumn("residual", S.residual("actual", "seasonal_naive"))
    sigma = F.stddev_pop("residual").over(Window.partitionBy(*KEYS))
    return table.select(
        *KEYS,
        "period_start",
        F.round("residual", 2).alias("residual"),
        F.round(S.standardized_residual("residual", sigma), 8).alias("standardized_residual"),
    )


@query(
    "point_errors",
    f"""WITH {_walk_sql('nation', 24, 12)}
SELECT oktmo, {r("sum(abs(actual - last_value)) / nullif(sum(abs(actual)), 0)", 9)} AS wape,
  {r("sqrt(avg((actual - last_value) ** 2))", 3)} AS rmse
FROM walk WHERE pos >= 24 GROUP BY 1""",
)
def point_errors(spark, sf):
    table = fc.baseline_forecasts(data.panel(spark, sf, "nation"), keys=KEYS, **PERIOD, min_train=24, unique=True)
    out = mt.point_errors(table, keys=["oktmo"], actual="actual", predicted="last_value")
    return out.withColumns({"wape": F.round("wape", 9), "rmse": F.round("rmse", 3)})


@query(
    "scaled_error",
    f"""WITH {_walk_sql('nation', 12, 12)},
h AS (SELECT oktmo, category_code, pos, CASE WHEN pos < 36 THEN actual END AS hist,
        CASE WHEN pos >= 36 THEN abs(actual - last_value) END AS err FROM walk),
s AS (SELECT *, abs(hist - lag(hist, 12) OVER (PARTITION BY oktmo, category_code ORDER BY pos)) AS step FROM h),
g AS (SELECT oktmo, category_code, count(hist) AS n, avg(step) AS scale, avg(err) AS mae FROM s GROUP BY 1, 2)
SELECT oktmo, category_code, {r("CASE WHEN n > 12 THEN mae / nullif(scale, 0) END", 8)} AS mase,
  CASE WHEN n <= 12 THEN 'SHORT_HISTORY' WHEN scale = 0 THEN 'FLAT_HISTORY' ELSE 'OK' END AS status
FROM g""",
)
def scaled_error(spark, sf):
    table = fc.rolling_origin(data.panel(spark, sf, "nation"), keys=KEYS, **PERIOD, min_train=12, unique=True)
    out = mt.scaled_error(
        table,
        keys=KEYS,
        period="period_start",
        actual="actual",
        predicted="last_value",
        insample=F.col("pos") < 36,
        seasonality=12,
    )
    return rounded(out, 8, "mase")


# ---- is the better forecast really better ------------------------------------

#: Two windows of the walk: all of it, and the last 24 months, which are too few errors for the loss test.
_LOSSES_SQL = f"""{_walk_sql('nation', 24, 12)},
placed AS (SELECT *, max(pos) OVER (PARTITION BY oktmo, category_code) - pos AS back FROM walk WHERE pos >= 24),
losses AS (SELECT w AS span, oktmo, category_code, pos, period_start, abs(actual - last_value) AS a, abs(actual - seasonal_naive) AS b
  FROM placed, (VALUES ('ALL'), ('LAST_24')) v(w) WHERE w = 'ALL' OR back < 24)"""
_SPAN = ["span", *KEYS]
_BY = "span, oktmo, category_code"


def _losses(spark, sf):
    """Losses of both forecasts in cents."""
    from pyspark.sql import Window

    table = fc.rolling_origin(data.panel(spark, sf, "nation"), keys=KEYS, **PERIOD, min_train=24, unique=True).where("pos >= 24")
    placed = table.withColumn("back", F.max("pos").over(Window.partitionBy(*KEYS)) - F.col("pos"))
    spans = F.when(F.col("back") < 24, F.array(F.lit("ALL"), F.lit("LAST_24"))).otherwise(F.array(F.lit("ALL")))
    long = placed.withColumn("span", F.explode(spans))
    # both forecasts are earlier amounts, so a loss is a whole number of cents and its sums are exact in any order
    error = lambda c: F.abs(F.rint(F.col("actual") * 100.0) - F.rint(F.col(c) * 100.0))
    return long.select(*_SPAN, "pos", error("last_value").alias("a"), error("seasonal_naive").alias("b"))


def _resampled_sql(units: str, unit: tuple[str, ...], by: str, value: str = "sum(w * a) / sum(w * b)") -> str:
    """Replicates of a ratio over rows (by, unit columns, a, b), and the interval per group."""
    return f"""drawn AS (SELECT *, {rs.hashed_sql("1", "k", *unit)} AS x FROM {units}, generate_series(1, 2000) g(k)),
weighed AS (SELECT *, {rs.weight_sql("x")} AS w FROM drawn),
replicates AS (SELECT {by}, k, {value} AS v FROM weighed WHERE w > 0 GROUP BY {by}, k),
ends AS (SELECT {by}, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS share_above
  FROM replicates GROUP BY {by}),
sizes AS (SELECT {by}, count(*) AS units, sum(a) / sum(b) AS estimate FROM {units} GROUP BY {by})"""


_STUDENT = """CASE WHEN f % 2 = 0 THEN sin(angle) * list_sum(list_transform(range(0, f // 2), lambda j: exp(2 * j * ln(cos(angle)) + lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1))))
  ELSE 2 / pi() * (angle + coalesce(sin(angle) * cos(angle) * list_sum(list_transform(range(0, f // 2), lambda j: exp(2 * j * ln(cos(angle)) + lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)))), 0)) END"""


@query(
    "loss_tests",
    f"""WITH {_LOSSES_SQL},
c AS (SELECT *, a - b - avg(a - b) OVER (PARTITION BY {_BY}) AS c FROM losses),
g AS (SELECT *, c * lag(c) OVER (PARTITION BY {_BY} ORDER BY pos) AS c1 FROM c),
m AS (SELECT {_BY}, count(*) AS errors, avg(a) AS mean_a, avg(a - b) AS difference, (sum(c * c) + 2 * sum(c1)) / count(*) AS variance FROM g GROUP BY ALL),
t AS (SELECT *, CASE WHEN variance > 0 THEN difference / sqrt(variance / errors) * sqrt((errors - 3 + 2.0 / errors) / errors) END AS statistic FROM m),
p AS (SELECT *, errors - 1 AS f, atan(abs(statistic) / sqrt(errors - 1)) AS angle FROM t),
tested AS (SELECT *, CASE WHEN errors >= 30 AND statistic IS NOT NULL THEN 'DIEBOLD_MARIANO' ELSE 'BLOCK_BOOTSTRAP' END AS method, greatest(0, 1 - {_STUDENT}) AS p_value FROM p),
units AS (SELECT {_BY}, block, sum(a - b) AS a, sum(1.0) AS b FROM (SELECT *, (row_number() OVER (PARTITION BY {_BY} ORDER BY pos) - 1) // 2 AS block
  FROM losses SEMI JOIN (SELECT * FROM tested WHERE method = 'BLOCK_BOOTSTRAP') USING ({_BY})) GROUP BY ALL),
{_resampled_sql("units", ("span", "oktmo", "category_code", "block"), _BY)}
SELECT span, oktmo, category_code, errors, {r("difference", 2)} AS difference, {r("statistic", 6)} AS statistic, {r("p_value", 7)} AS p_value, method,
  {r("CASE WHEN units >= 10 THEN lower END", 2)} AS lower, {r("CASE WHEN units >= 10 THEN upper END", 2)} AS upper, {r("difference / nullif(mean_a, 0)", 8)} AS reduction,
  CASE WHEN method = 'DIEBOLD_MARIANO' THEN p_value < 0.05 AND statistic > 0 ELSE coalesce(units >= 10 AND lower > 0, false) END AND difference / nullif(mean_a, 0) >= 0.05 AS accepted
FROM tested LEFT JOIN ends USING ({_BY}) LEFT JOIN sizes USING ({_BY})""",
)
def loss_tests(spark, sf):
    """Seasonal naive against last value: the loss test with the first autocovariance, else block resampling."""
    plan = rs.Resampling()
    out = sg.loss_test(_losses(spark, sf), keys=_SPAN, order="pos", loss_a=F.col("a"), loss_b=F.col("b"), horizon=2, block=2, plan=plan)
    out = out.withColumns({c: F.col(c) / 100.0 for c in ("difference", "lower", "upper")})
    out = out.select(*_SPAN, "errors", "difference", "statistic", "p_value", "method", "lower", "upper", "reduction", "accepted")
    return rounded(rounded(rounded(rounded(out, 2, "difference", "lower", "upper"), 6, "statistic"), 7, "p_value"), 8, "reduction")


@query(
    "pooled_loss_interval",
    f"""WITH {_LOSSES_SQL},
units AS (SELECT category_code, oktmo, block, sum(a - b) AS a, sum(a) AS b FROM (SELECT *, (row_number() OVER (PARTITION BY oktmo, category_code ORDER BY pos) - 1) // 3 AS block
  FROM losses WHERE span = 'ALL') GROUP BY ALL),
{_resampled_sql("units", ("category_code", "oktmo", "block"), "category_code")}
SELECT category_code, units, {r("estimate", 8)} AS estimate, {r("lower", 8)} AS lower, {r("upper", 8)} AS upper, {r("share_above", 6)} AS share_above
FROM sizes JOIN ends USING (category_code)""",
)
def pooled_loss_interval(spark, sf):
    """Relative loss reduction over all territories of a category, resampled by blocks of a quarter."""
    rows = rs.blocks(_losses(spark, sf).where("span = 'ALL'"), keys=KEYS, order="pos", length=3)
    out = rs.ratio_interval(rows, keys=["category_code"], unit=["oktmo", "block"], numerator=F.col("a") - F.col("b"), denominator=F.col("a"))
    return rounded(rounded(out, 8, "estimate", "lower", "upper"), 6, "share_above")


# ---- averages over territories -----------------------------------------------


@query(
    "weighted_averages",
    f"""WITH {_walk_sql('nation', 24, 12)},
e AS (SELECT oktmo, period_start, m AS model, CASE m WHEN 'last_value' THEN abs(actual - last_value) WHEN 'seasonal_naive' THEN abs(actual - seasonal_naive) ELSE abs(actual - linear_trend) END / actual AS ape
  FROM walk, (VALUES ('last_value'), ('seasonal_naive'), ('linear_trend')) v(m) WHERE pos >= 24 AND actual > 0),
people AS (SELECT n_name AS oktmo, make_date(year(o_orderdate), 12, 31) AS day, count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
w AS (SELECT e.*, n AS population FROM e ASOF LEFT JOIN people ON e.oktmo = people.oktmo AND e.period_start >= people.day)
SELECT model, count(*) AS rows, {r("avg(ape)", 9)} AS ape_macro, {r("sum(ape * population) / sum(population)", 9)} AS ape_population, count(population) AS weighted_rows FROM w GROUP BY 1""",
)
def weighted_averages(spark, sf):
    """Relative errors of the baselines: each territory alike, and by the customers known at the time."""
    table = fc.baseline_forecasts(data.panel(spark, sf, "nation"), keys=KEYS, **PERIOD, min_train=24, unique=True).where("actual > 0")
    errors = [F.struct(F.lit(m).alias("model"), (F.abs(F.col("actual") - F.col(m)) / F.col("actual")).alias("ape")) for m in fc.BASELINES]
    long = table.select("oktmo", "period_start", F.inline(F.array(*errors)))
    orders = data.at_buyer(spark, sf, data.read(spark, sf, "orders").select("o_custkey", "o_orderdate"))
    day = F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("day")
    people = orders.groupBy(F.col("n_name").alias("oktmo"), day).agg(F.count_distinct("o_custkey").alias("population"))
    weighed = mt.asof_weight(long, people, keys=["oktmo"], period="period_start", at="day", weight="population")
    out = mt.averages(weighed, by=["model"], metrics=["ape"], weights=["population"])
    counted = weighed.groupBy("model").agg(F.count("population").alias("weighted_rows"))
    return rounded(out.join(counted, "model"), 9, "ape_macro", "ape_population")


@query("growth_model_forecast")
def growth_model_forecast(spark, sf):
    from tesora.operators.growth import rolling_growth_forecast

    return rolling_growth_forecast(data.panel(spark, sf, "region"), holdout_year=2001, unique=True)
