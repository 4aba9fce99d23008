from __future__ import annotations

import datetime as dt
import math

import random

import pytest
from pyspark.sql import functions as F

from tesora.operators import forecast as fc
from tesora.operators import metrics as mt
from tesora.operators import panel as pn

# monthly spending of one territory, 2023-01 to 2024-12, as published
SPENDING = [
    36408, 36554, 40736, 39245, 41744, 42103, 44505, 43904, 40521, 42928, 42089, 48279,
    41034, 42789, 47338, 46529, 47412, 49352, 50565, 50202, 45625, 48736, 47979, 55515,
]
PUBLISHED = {
    "Last Value": (2894.8333333333335, -0.111988087616818, 0.06061674193300714, 3775.534774483389, 1.2997741404411065),
    "Seasonal Naive": (6171.666666666667, -2.0216437290603175, 0.12923242292470807, 6223.719854984905, 2.771065485666082),
    "Linear Trend": (2391.0544029814305, 0.3339335712825575, 0.05006779700384795, 2922.0468825736375, 1.0735784494385785),
}


def months(n, start=dt.date(2023, 1, 1)):
    return [dt.date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1) for i in range(n)]


def series(spark, values, name="a"):
    data = [(name, d, float(v)) for d, v in zip(months(len(values)), values)]
    return spark.createDataFrame(data, "series string, period date, value double")


def panel(spark, values, **extra):
    data = [("71876000", "ALL", d, float(v)) for d, v in zip(months(len(values)), values)]
    df = spark.createDataFrame(data, "oktmo string, category_code string, period_start date, spending_nominal double")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def test_published_metrics(spark):
    got = fc.tournament(series(spark, SPENDING), keys=["series"], holdout_year=2024).collect()
    assert len(got) == 3
    for row in got:
        want = PUBLISHED[row["model"]]
        for name, value in zip(("mae", "r2", "wape", "rmse", "mase"), want):
            assert row[name] == pytest.approx(value, rel=1e-10)
        assert row["observations"] == 12
    assert {r["model"]: r["rank_mae"] for r in got} == {"Linear Trend": 1, "Last Value": 2, "Seasonal Naive": 3}


def test_trend_beats_seasonal_on_a_line(spark):
    got = {r["model"]: r for r in fc.tournament(series(spark, range(100, 118)), keys=["series"], min_train=12).collect()}
    assert got["Linear Trend"]["observations"] == 6
    for m in ("mae", "rmse"):
        assert got["Linear Trend"][m] < got["Seasonal Naive"][m]
    assert got["Linear Trend"]["r2"] > got["Seasonal Naive"]["r2"]
    assert fc.champions(fc.tournament(series(spark, range(100, 118)), keys=["series"]).drop("rank_mae"), keys=["series"]).first()[
        "model"
    ] == "Linear Trend"


def test_forecasts_match_a_plain_walk(spark):
    table = fc.baseline_forecasts(series(spark, SPENDING), keys=["series"], min_train=12).orderBy("period").collect()
    for i, row in zip(range(12, 24), table):
        past = SPENDING[:i]
        assert row["last_value"] == past[-1]
        assert row["seasonal_naive"] == past[-12]
        x = list(range(i))
        mx, my = sum(x) / i, sum(past) / i
        slope = sum((a - mx) * (b - my) for a, b in zip(x, past)) / sum((a - mx) ** 2 for a in x)
        assert row["linear_trend"] == pytest.approx(my + slope * (i - mx))


def test_matrix_uses_only_earlier_rows(spark):
    df = panel(spark, range(100, 114), model_eligible=True, identity_status="OKTMO_RESOLVED")
    row = pn.consumption_matrix(df).where(F.col("history_points") == 12).first()
    assert (row["target"], row["lag_1"], row["lag_12"], row["rolling_mean_3"]) == (112.0, 111.0, 100.0, 110.0)
    assert row["yoy_change_lagged"] == pytest.approx(111 / 100 - 1)
    first = pn.consumption_matrix(df).where(F.col("history_points") == 1).first()
    assert first["rolling_std_3"] is None and first["rolling_mean_3"] == 100.0
    assert first["month_sin"] == pytest.approx(math.sin(2 * math.pi * 2 / 12))


def test_matrix_refuses_repeated_keys_and_unresolved_rows(spark):
    df = panel(spark, [1, 2, 3])
    with pytest.raises(Exception, match="panel key repeats"):
        pn.consumption_matrix(df.unionByName(df.limit(1))).collect()
    assert pn.consumption_matrix(df.withColumn("identity_status", F.lit("UNRESOLVED"))).count() == 0
    assert pn.consumption_matrix(df, categories=["FOOD"]).count() == 0
    with pytest.raises(ValueError, match="positive"):
        pn.consumption_matrix(df, lags=(0,))


def test_scope_and_split(spark):
    df = panel(spark, SPENDING)
    peers, target = pn.scope(df, target="71876000", prefix="71")
    parts = pn.holdout_split(target, holdout_year=2024)
    assert (peers.count(), parts.clean.count(), parts.quarantine.count()) == (24, 12, 12)
    ready = pn.holdout_readiness(df, holdout_year=2025).first()
    assert not ready["ready"]


def test_calendar_fill(spark):
    df = panel(spark, [1, 2, 3, 4]).where(F.col("spending_nominal") != 3)
    filled = pn.fill_calendar(df, ["oktmo", "category_code"])
    assert filled.count() == 4 and filled.where(F.col("spending_nominal").isNull()).count() == 1


def test_fold_sums_equal_a_plain_count(spark):
    values = {"a": [float(i * i % 17) for i in range(40)], "b": [1.0] * 20, "c": [2.0] * 9}
    rows = [(k, f"{2000 + i // 12}-{i % 12 + 1:02d}-01", v) for k, x in values.items() for i, v in enumerate(x)]
    panel = spark.createDataFrame(rows, "k string, p string, v double").withColumn("p", F.col("p").cast("date"))
    lengths = panel.groupBy("k").count().withColumnRenamed("count", "n_periods")
    folds = fc.expanding_folds(lengths, min_train=6, horizon=2, holdout=3, step=4)
    got = {(r["k"], r["train_end"], r["part"]): (r["n_rows"], r["total"]) for r in fc.fold_sums(panel, folds, keys=["k"], period="p", value="v").collect()}
    want = {}
    for k, x in values.items():
        for e in range(6, len(x) - 4, 4):
            want[k, e, "TRAIN"], want[k, e, "TEST"] = (e, sum(x[:e])), (2, sum(x[e : e + 2]))
    assert got == want


def test_folds(spark):
    lengths = spark.createDataFrame([("a", 40), ("b", 30)], "s string, n_periods int")
    folds = fc.expanding_folds(lengths, min_train=24, horizon=1, holdout=12, step=1).orderBy("train_end").collect()
    assert [(f["train_end"], f["test_end"], f["holdout_start"], f["holdout_end"]) for f in folds] == [
        (24, 25, 28, 40),
        (25, 26, 28, 40),
        (26, 27, 28, 40),
        (27, 28, 28, 40),
    ]
    assert [r["s"] for r in fc.too_short(lengths).collect()] == ["b"]


def test_point_and_scaled_errors(spark):
    df = spark.createDataFrame([("a", 100.0, 90.0), ("a", 100.0, 110.0), ("z", 0.0, 1.0)], "k string, y double, p double")
    got = {r["k"]: r for r in mt.point_errors(df, keys=["k"], actual="y", predicted="p").collect()}
    assert got["a"]["wape"] == pytest.approx(0.1) and got["z"]["wape"] is None
    two = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 1.0)], "k string, y double, p double")
    assert mt.point_errors(two, keys=["k"], actual="y", predicted="p").first()["rmse"] == pytest.approx(1.414214, abs=1e-6)
    hist = spark.createDataFrame(
        [("a", i, float(v), float(v), h) for i, (v, h) in enumerate([(1, True), (2, True), (4, True), (7, False)])],
        "k string, t int, y double, p double, h boolean",
    ).withColumn("p", F.lit(4.0))
    out = mt.scaled_error(hist, keys=["k"], period="t", actual="y", predicted="p", insample=F.col("h")).first()
    assert out["mase"] == pytest.approx(3 / 1.5) and out["status"] == "OK"


def test_outside_forecast_scores(spark):
    hist = series(spark, SPENDING[:12])
    future = spark.createDataFrame([("a", 41034.0, 42000.0), ("a", 42789.0, 42000.0)], "series string, actual double, predicted double")
    row = fc.score_forecasts(future, hist, keys=["series"]).first()
    steps = [abs(b - a) for a, b in zip(SPENDING[:11], SPENDING[1:12])]
    assert row["mase"] == pytest.approx(((966 + 789) / 2) / (sum(steps) / 11))


def test_growth_model_is_leakage_free(spark):
    from tesora.operators.growth import rolling_growth_forecast

    a = panel(spark, SPENDING)
    b = panel(spark, [v * 2 for v in SPENDING]).withColumn("oktmo", F.lit("71874000"))
    both = a.unionByName(b)
    out = rolling_growth_forecast(both, holdout_year=2024, iterations=2, depth=2)
    assert out.count() == 24 and out.where(F.col("grow_prediction").isNull()).count() == 0
    # the first holdout month must not see anything later
    changed = both.withColumn(
        "spending_nominal", F.when(F.col("period_start") > F.lit("2024-01-01").cast("date"), 1.0).otherwise(F.col("spending_nominal"))
    )
    again = rolling_growth_forecast(changed, holdout_year=2024, iterations=2, depth=2)
    first = lambda d: sorted(r["grow_prediction"] for r in d.where(F.month("period_start") == 1).collect())
    assert first(out) == pytest.approx(first(again))


def test_ordered_statistic_sees_earlier_periods_only(spark):
    from tesora.operators.growth import ordered_statistic

    rng = random.Random(1)
    rows = [(k, t, rng.gauss(0, 1) if rng.random() < 0.8 else None) for t in range(6) for k in "abc" for _ in range(rng.randint(1, 3))]
    out = ordered_statistic(spark.createDataFrame(rows, "k string, t int, g double"), "k", period="t", label="g", out="m", prior_rows=2.0)
    got = {(r.k, r.t): r.m for r in out.collect()}
    assert out.count() == len(rows)
    for (k, t), m in got.items():
        before = [g for _, s, g in rows if s < t and g is not None]
        own = [g for c, s, g in rows if c == k and s < t and g is not None]
        want = (sum(own) + 2 * sum(before) / len(before)) / (len(own) + 2) if before else None
        assert m == pytest.approx(want)


def test_nominal_keys_must_be_few(spark):
    from tesora.operators import growth

    wide = panel(spark, SPENDING).withColumn("category_code", F.explode(F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: i.cast("string"))))
    with pytest.raises(ValueError, match="category_code"):
        growth.rolling_growth_forecast(wide, holdout_year=2024, iterations=1, depth=1)
