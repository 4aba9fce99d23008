from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesora.operators import metrics as mt
from tesora.operators import prefix as px


def plain_auc(y, s):
    won = sum((a > b) + 0.5 * (a == b) for a, ya in zip(s, y) if ya for b, yb in zip(s, y) if not yb)
    return won / (sum(y) * (len(y) - sum(y)))


def plain_ap(y, s):
    order = sorted(range(len(s)), key=lambda i: -s[i])
    tp = total = 0
    for rank, i in enumerate(order, 1):
        if y[i]:
            tp += 1
            total += tp / rank
    return total / sum(y)


@pytest.mark.parametrize("pieces", [1, 3, 16])
def test_areas_with_a_hot_score(spark, pieces):
    rng = random.Random(7)
    y = [int(rng.random() < 0.3) for _ in range(400)]
    # a third of all rows share one score
    s = [5.0 if rng.random() < 0.34 else float(rng.randint(0, 40)) for _ in y]
    df = spark.createDataFrame([("m", a, b, i) for i, (a, b) in enumerate(zip(y, s))], "m string, y int, s double, q long")
    auc = mt.roc_auc(df, keys=["m"], truth="y", score="s", pieces=pieces).first()
    ap = mt.average_precision(df, keys=["m"], truth="y", score="s", seq="q", pieces=pieces).first()
    assert auc["roc_auc"] == pytest.approx(plain_auc(y, s))
    assert ap["average_precision"] == pytest.approx(plain_ap(y, s))


def test_perfect_order(spark):
    df = spark.createDataFrame([("m", y, s, i) for i, (y, s) in enumerate(zip([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]))], "m string, y int, s double, q long")
    assert mt.roc_auc(df, keys=["m"], truth="y", score="s").first()["roc_auc"] == 1.0
    assert mt.average_precision(df, keys=["m"], truth="y", score="s", seq="q").first()["average_precision"] == 1.0


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 1, 0.7)], "m string, y int, s double")
    assert mt.roc_auc(df, keys=["m"], truth="y", score="s").first()["roc_auc"] is None


def test_dual_value(spark):
    y = [0, 1, 0, 1, 0, 1]
    r = [0.1, 0.6, 0.2, 0.55, 0.3, 0.65]
    p = [0.2, 0.55, 0.4, 0.8, 0.1, 0.7]
    d = [0.1, 0.7, 0.2, 0.9, 0.05, 0.85]
    df = spark.createDataFrame(list(zip(y, r, p, d, range(6))), "y int, r double, p double, d double, q long")
    out = mt.dual_value(df, truth="y", reference="r", predictive="p", dual="d", seq="q").first()
    assert out["delta_roc_auc"] >= 0 and out["delta_pr_auc"] >= 0
    assert out["roc_auc_reference"] == pytest.approx(plain_auc(y, r))
    assert out["pr_auc_predictive"] == pytest.approx(plain_ap(y, p))


def test_lead_time_and_false_alarms(spark):
    days = spark.range(1).select(mt.lead_time_days(F.lit("2024-04-15"), F.lit("2024-07-01")).alias("d")).first()["d"]
    assert days == 77
    rows = [("A", 2024, 1, 0), ("A", 2024, 0, 0), ("B", 2024, 0, 1)]
    df = spark.createDataFrame(rows, "entity string, year int, alarm int, truth int")
    out = mt.false_alarms_per_unit(df, entity="entity", year="year", alarm="alarm", truth="truth").first()
    assert out["false_alarms_per_entity_year"] == 0.5
    empty = mt.false_alarms_per_unit(df.limit(0), entity="entity", year="year", alarm="alarm", truth="truth").first()
    assert empty["false_alarms_per_entity_year"] == 0.0


def test_precision_recall(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("a", 1, 0), ("b", 0, 0)], "k string, y int, p int")
    got = {r["k"]: (r["precision"], r["recall"]) for r in mt.precision_recall(df, keys=["k"], truth="y", alarm="p").collect()}
    assert got == {"a": (0.5, 0.5), "b": (0.0, 0.0)}


@pytest.mark.parametrize("pieces", [1, 5])
def test_ranks_and_medians(spark, pieces):
    rng = random.Random(3)
    data = [("g", float(rng.randint(0, 30))) for _ in range(300)] + [("h", 1.0), ("h", 2.0), ("h", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r["g"], r["v"]): r for r in px.value_ranks(df, ["g"], "v", pieces=pieces).collect()}
    values = sorted(v for g, v in data if g == "g")
    for v in set(values):
        row = got[("g", v)]
        below, ties = sum(x < v for x in values), values.count(v)
        assert row["mid_rank"] == below + (ties + 1) / 2
        assert row["percentile_rank"] == pytest.approx((below + ties) / len(values))
    assert got[("h", 2.0)]["percentile_rank"] == 1.0
    med = {r["g"]: r["median"] for r in px.exact_median(df, ["g"], "v", pieces=pieces).collect()}
    assert med == {"g": (values[149] + values[150]) / 2, "h": 1.5}


@pytest.mark.parametrize("cut", [False, True])
def test_the_latest_weight_not_after_the_period(spark, cut):
    import datetime as dt

    from tesora.operators.prefix import cut_series

    rng = random.Random(5)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 40))
    facts = [(k, i, day()) for i in range(80) for k in "ab"] + [("c", 1, day()), (None, 2, day())]
    known = [(k, day(), float(rng.randint(1, 9))) for k in ("a", "a", "a", "a", "b", "b", None) for _ in range(2)] + [("a", None, 9.0), ("a", dt.date(2023, 1, 1), None)]
    df = spark.createDataFrame(facts, "k string, i int, t date").repartition(3)
    weights = spark.createDataFrame(known, "k string, d date, w double")
    by = {"block": "piece", "pieces": lambda line: cut_series(line, ["k"], "_at", pieces=6)} if cut else {}
    out = mt.asof_weight(df, weights, keys=["k"], period="t", at="d", weight="w", **by)

    def latest(k, t):
        seen = [(d, w) for key, d, w in known if key == k and d is not None and w is not None and d <= t]
        return max(seen)[1] if seen else None

    assert sorted(map(tuple, out.collect()), key=str) == sorted(((k, i, t, latest(k, t)) for k, i, t in facts), key=str)


def test_macro_and_weighted_means(spark):
    df = spark.createDataFrame([("m", 0.1, 1.0), ("m", 0.3, 3.0), ("m", None, 9.0), ("m", 0.5, None), ("n", None, None)], "model string, e double, w double")
    out = {r.model: r for r in mt.averages(df, by=["model"], metrics=["e"], weights=["w"]).collect()}
    assert (out["m"].e_macro, out["m"].e_w, out["m"].rows) == (pytest.approx(0.3), pytest.approx(0.25), 4)
    assert out["n"].e_macro is None and out["n"].e_w is None
