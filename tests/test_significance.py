from __future__ import annotations

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesora.operators import resample as rs
from tesora.operators import significance as sg


def plain_weight(seed, replicate, *unit):
    text = "|".join(["" if x is None else str(x) for x in (seed, replicate, *unit)])
    number = int(hashlib.md5(text.encode()).hexdigest()[:7], 16)
    return sum(number >= p for p in rs.POISSON)


def plain_ratio(units, plan):
    """(estimate, lower, upper) of {unit: (a, b)} by drawing every replicate."""
    values = []
    for k in range(1, plan.replicates + 1):
        w = {u: plain_weight(plan.seed, k, *u) for u in units}
        den = sum(w[u] * b for u, (_, b) in units.items())
        if den:
            values.append(sum(w[u] * a for u, (a, _) in units.items()) / den)
    ends = (1 - plan.level) / 2, (1 + plan.level) / 2
    return (sum(a for a, _ in units.values()) / sum(b for _, b in units.values()), *np.quantile(values, ends).tolist())


def test_weights_are_poisson_and_independent():
    w = np.array([[plain_weight(1, k, "g", u) for k in range(300)] for u in range(40)], float)
    assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.05)
    between = np.corrcoef(w)[np.triu_indices(40, 1)]
    assert abs(between.mean()) < 0.01 and between.std() == pytest.approx(1 / math.sqrt(300), rel=0.2)


def test_ratio_interval_equals_drawing_every_replicate(spark):
    rng = random.Random(1)
    rows = [(g, u, rng.gauss(1, 2), rng.uniform(1, 2)) for g in ("a", None) for u in range(12) for _ in range(3)] + [("few", 1, 1.0, 2.0), ("a", 3, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, u int, x double, y double").repartition(3)
    plan = rs.Resampling(replicates=200, seed=5)
    found = {r.g: r for r in rs.ratio_interval(df, keys=["g"], unit=["u"], numerator=F.col("x"), denominator=F.col("y"), plan=plan).collect()}
    units = {}
    for g, u, x, y in rows:
        if g == "a" and x is not None:
            units[g, u] = tuple(p + q for p, q in zip(units.get((g, u), (0, 0)), (x, y), strict=True))
    assert (found["a"].estimate, found["a"].lower, found["a"].upper) == pytest.approx(plain_ratio(units, plan))
    assert found["a"].units == 12 and found["few"].units == 1 and found["few"].lower is None and found["few"].estimate == 0.5
    again = rs.ratio_interval(df.repartition(7), keys=["g"], unit=["u"], numerator=F.col("x"), denominator=F.col("y"), plan=plan)
    assert {r.g: r.units for r in again.collect()} == {r.g: r.units for r in found.values()}
    assert again.where("g = 'a'").first().lower == pytest.approx(found["a"].lower, rel=1e-12)


def test_quantile_interval_equals_repeating_the_units(spark):
    rng = random.Random(2)
    rows = [("g", u, float(rng.choice([0, 5, 5, 30, 61]))) for u in range(15)]
    plan = rs.Resampling(replicates=150)
    got = rs.quantile_interval(spark.createDataFrame(rows, "k string, u int, v double"), keys=["k"], unit=["u"], value="v", plan=plan).first()
    medians = []
    for k in range(1, 151):
        held = sorted(v for _, u, v in rows for _ in range(plain_weight(1, k, "g", u)))
        if held:
            medians.append(held[math.ceil(len(held) / 2) - 1])
    assert got.estimate == sorted(v for *_, v in rows)[7]
    assert (got.lower, got.upper) == pytest.approx(tuple(np.quantile(medians, [0.025, 0.975])))


def test_blocks_follow_the_order(spark, rows):
    df = spark.createDataFrame([("a", t) for t in (5, 1, 9, 3, 7)], "k string, t int")
    assert rows(rs.blocks(df, keys=["k"], order="t", length=2), "t", "block") == sorted([(1, 0), (3, 0), (5, 1), (7, 1), (9, 2)])


@pytest.mark.parametrize(("t", "freedom", "p"), [(12.706, 1, 0.05), (4.303, 2, 0.05), (-2.228, 10, 0.05), (2.228, 10, 0.05), (2.045, 29, 0.05), (2.0003, 60, 0.05), (0.0, 7, 1.0)])
def test_student_tail(spark, t, freedom, p):
    got = spark.range(1).select(sg.student_two_sided(F.lit(t), F.lit(freedom)).alias("p")).first().p
    assert got == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize("z", [0.0, 0.3, -1.959964, 3.0, 6.0, 12.0])
def test_normal_tail(spark, z):
    got = spark.range(1).select(sg.normal_two_sided(F.lit(z)).alias("p")).first().p
    assert got == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-12)


def plain_loss_test(a, b, horizon):
    d = [x - y for x, y in zip(a, b, strict=True)]
    n, m = len(d), sum(d) / len(d)
    cov = [sum((d[i] - m) * (d[i - k] - m) for i in range(k, n)) / n for k in range(horizon)]
    v = cov[0] + 2 * sum(cov[1:])
    return m, v, m / math.sqrt(v / n) * math.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)


@pytest.mark.parametrize("horizon", [1, 3])
def test_loss_test_equals_the_formula(spark, horizon):
    rng = random.Random(horizon)
    a, b = [abs(rng.gauss(0, 2)) for _ in range(40)], [abs(rng.gauss(0, 1)) for _ in range(40)]
    rows = [("s", t, a[t], b[t]) for t in range(40)] + [("flat", t, 1.0, 1.0) for t in range(40)] + [("s", 99, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, a double, b double").repartition(3)
    out = {r.k: r for r in sg.diebold_mariano(df, keys=["k"], order="t", loss_a=F.col("a"), loss_b=F.col("b"), horizon=horizon).collect()}
    assert (out["s"].difference, out["s"].variance, out["s"].statistic) == pytest.approx(plain_loss_test(a, b, horizon))
    assert out["s"].errors == 40 and out["flat"].statistic is None and out["flat"].p_value is None


def test_few_errors_go_to_the_interval(spark):
    rng = random.Random(8)
    rows = [(k, t, 3 + rng.random(), 1 + rng.random()) for k, n in (("long", 36), ("short", 24), ("tiny", 4)) for t in range(n)]
    rows += [("one", 0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "k string, t int, a double, b double")
    out = {r.k: r for r in sg.loss_test(df, keys=["k"], order="t", loss_a=F.col("a"), loss_b=F.col("b"), block=2, plan=rs.Resampling(replicates=200)).collect()}
    assert out["long"].method == "DIEBOLD_MARIANO" and out["long"].accepted and out["long"].lower is None
    assert out["short"].method == "BLOCK_BOOTSTRAP" and out["short"].accepted and out["short"].lower > 1
    assert not out["tiny"].accepted and out["tiny"].lower is None and out["one"].statistic is None


def plain_areas(rows):
    pos, neg = [r[1:] for r in rows if r[0] == 1], [r[1:] for r in rows if r[0] == 0]
    beats = lambda p, q: 0.5 * (p == q) + (p > q)
    v1 = np.array([[np.mean([beats(p[s], q[s]) for q in neg]) for p in pos] for s in (0, 1)])
    v0 = np.array([[np.mean([beats(p[s], q[s]) for p in pos]) for q in neg] for s in (0, 1)])
    d1, d0 = v1[1] - v1[0], v0[1] - v0[0]
    return v1.mean(axis=1), d1.var(ddof=1) / len(pos) + d0.var(ddof=1) / len(neg)


def test_area_test_equals_the_pairwise_form(spark):
    rng = random.Random(4)
    rows = [(y, round(rng.gauss(y, 1), 1), round(rng.gauss(2 * y, 1), 1)) for y in (0, 1, 1, 0, 0) * 20]
    df = spark.createDataFrame([("g", *r) for r in rows] + [("g", 1, None, 1.0), ("g", None, 1.0, 1.0), ("h", 1, 1.0, 1.0), ("h", 0, 1.0, 2.0)], "k string, y int, a double, b double")
    out = {r.k: r for r in sg.delong(df.repartition(3), keys=["k"], truth="y", scores=["a", "b"]).collect()}
    (auc_a, auc_b), variance = plain_areas(rows)
    got = out["g"]
    assert (got.auc_against, got.auc, got.variance) == pytest.approx((auc_a, auc_b, variance))
    assert got.statistic == pytest.approx((auc_b - auc_a) / math.sqrt(variance)) and got.usable and got.positives == 40
    assert not out["h"].usable and out["h"].statistic is None


def test_utility_equals_counting_at_every_threshold(spark):
    rng = random.Random(6)
    rows = [("g", u, rng.randint(0, 1), float(rng.randint(0, 9))) for u in range(60)]
    df = spark.createDataFrame(rows, "k string, u int, y int, s double").repartition(3)
    costs = {"benefit": 5.0, "false_alarm": 2.0, "miss": 1.0, "model_cost": 3.0}

    def effect(h):
        return sum(5 if s >= h and y else -2 if s >= h else -1 if y else 0 for *_, y, s in rows) - 3

    table = sg.utility_by_threshold(df, keys=["k"], truth="y", score="s", **costs)
    assert {r.threshold: r.net_effect for r in table.collect()} == {h: effect(h) for *_, h in rows}
    best = sg.best_threshold(table, keys=["k"])
    top = max((effect(h), h) for *_, h in rows)
    assert (best.first().net_effect, best.first().threshold) == top
    plan = rs.Resampling(replicates=200)
    got = sg.net_effect_interval(df, best, keys=["k"], unit=["u"], truth="y", score="s", **costs, plan=plan).first()
    assert got.estimate * 60 == pytest.approx(top[0]) and got.lower < got.estimate < got.upper and got.accepted == (got.lower > 0)


def test_settings_are_checked(spark):
    for bad in ({"replicates": 10}, {"level": 1.0}, {"least_units": 0}):
        with pytest.raises(ValueError):
            rs.Resampling(**bad)
    with pytest.raises(ValueError):
        sg.diebold_mariano(spark.range(1), keys=["id"], order="id", loss_a=F.lit(1), loss_b=F.lit(1), horizon=0)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="shared tables are absent")
def test_differences_of_half_a_cent_are_rounded_from_exact_sums(spark):
    from decimal import ROUND_HALF_UP, Decimal
    from fractions import Fraction

    from oracle_check import connect

    from tesora.plans import forecasting as fp

    whole = "SELECT span, oktmo, category_code, count(*), CAST(sum(CAST(round(100 * a) AS BIGINT) - CAST(round(100 * b) AS BIGINT)) AS BIGINT) FROM losses GROUP BY ALL"
    sums = connect("/root/testdata/sf0.1").execute(f"WITH {fp._LOSSES_SQL} {whole}").fetchall()
    exact = {tuple(key): Fraction(cents, n) for *key, n, cents in sums}
    assert sum(e.denominator == 2 for e in exact.values()) > 5  # halves of a cent do occur
    want = {k: float((Decimal(e.numerator) / e.denominator).quantize(Decimal(1), ROUND_HALF_UP) / 100) for k, e in exact.items()}
    got = fp.loss_tests(spark, "/root/testdata/sf0.1").select("span", "oktmo", "category_code", "difference").collect()
    assert {(r.span, r.oktmo, r.category_code): r.difference for r in got} == want
