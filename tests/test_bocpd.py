from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from test_streaming import landed, run

from tesora.operators.bocpd import NAMES, RunLengthModel, RunLengths, run_lengths
from tesora.streaming import online


def segment_evidence(x, m):
    """Log marginal likelihood of one segment under the normal-gamma prior."""
    n = len(x)
    mean = sum(x) / n
    m2 = sum((v - mean) ** 2 for v in x)
    strength, shape = m.strength + n, m.shape + n / 2
    rate = m.rate + m2 / 2 + m.strength * n * (mean - m.mean) ** 2 / (2 * strength)
    return (
        math.lgamma(shape) - math.lgamma(m.shape) + m.shape * math.log(m.rate) - shape * math.log(rate)
        + 0.5 * math.log(m.strength / strength) - n / 2 * math.log(2 * math.pi)
    )


def plain_posterior(x, m):
    """Chance of every run length after the last point, by summing over all ways to cut the series."""
    n, h = len(x), 1 / m.expected_run
    weight = {}
    for cuts in itertools.product((False, True), repeat=n):  # cut after point i
        at, total = 0, 0.0
        for i, cut in enumerate(cuts):
            total += math.log(h if cut else 1 - h)
            if cut:
                total += segment_evidence(x[at : i + 1], m)
                at = i + 1
        if at < n:
            total += segment_evidence(x[at:], m)
        weight[n - at] = weight.get(n - at, 0.0) + math.exp(total)
    whole = sum(weight.values())
    return {r: w / whole for r, w in weight.items()}


@pytest.mark.parametrize("model", [RunLengthModel(tolerance=0), RunLengthModel(0.5, 2.0, 1.5, 0.7, 5.0, 0.0)])
def test_posterior_equals_the_sum_over_all_segmentations(model):
    rng = random.Random(1)
    x = [rng.gauss(0, 1) for _ in range(5)] + [rng.gauss(4, 1) for _ in range(4)]
    state = RunLengths(model)
    for v in x:
        state.step(v)
    want = plain_posterior(x, model)
    assert {int(n): p for n, p in zip(*state.runs[:2], strict=True)} == pytest.approx(want, rel=1e-9)


def test_pruning_keeps_the_stated_bound():
    rng = random.Random(2)
    x = [rng.gauss(3 * (i // 60 % 2), 1) for i in range(300)]
    exact, cut = RunLengths(RunLengthModel(tolerance=0)), RunLengths(RunLengthModel(tolerance=1e-6))
    most = 0
    for v in x:
        a, b = exact.step(v), cut.step(v)
        most = max(most, b[4])
        assert b[1] == a[1] and b[2] == pytest.approx(a[2], abs=1e-4)
    assert cut.lost <= 300 * 1e-6 and len(exact.runs[0]) == 301 > 2 * most


def test_a_shift_raises_the_alarm_and_a_flat_series_does_not(spark, rows):
    data = [("flat", t, 1.0) for t in range(40)] + [("shift", t, (-1) ** t * 0.1 + 8.0 * (t >= 25)) for t in range(40)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    out = run_lengths(df, keys=["k"], order="t", value="v", model=RunLengthModel(expected_run=50))
    assert rows(out.where("bocpd_flag").groupBy("k").agg({"t": "min"})) == [("shift", 25)]
    assert out.where("k = 'shift' AND t = 39").first().run_length == 15


def test_nulls_repeats_and_empty_input(spark):
    data = [("a", 1, 1.0), ("a", 2, None), ("a", 3, float("nan")), ("a", 4, float("inf")), ("a", 5, 2.0), (None, 1, 1.0), (None, 1, 1.0)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    out = run_lengths(df, keys=["k"], order="t", value="v")
    assert sorted((r.k or "", r.t, r.pos) for r in out.collect()) == [("", 1, 0), ("", 1, 1), ("a", 1, 0), ("a", 5, 1)]
    assert run_lengths(df.limit(0), keys=["k"], order="t", value="v").count() == 0


def test_settings_are_checked():
    for bad in ({"rate": 0.0}, {"expected_run": 1.0}, {"tolerance": 1.0}, {"threshold": 0.0}):
        with pytest.raises(ValueError):
            RunLengthModel(**bad)


def test_stream_equals_the_batch(spark):
    online.use_rocksdb(spark)
    rng = np.random.default_rng(3)
    data = [(f"s{k}", t, float(rng.normal() + 5 * (t > 22 and k % 2))) for k in range(4) for t in range(36)]
    df = spark.createDataFrame(data, "series_id string, t long, value double")
    late = spark.createDataFrame([("s1", 2, 9.0)], df.schema)
    model = RunLengthModel(tolerance=1e-9)
    got = run(spark, online.run_length_stream(landed(spark, df.where("t < 13"), df.where("t >= 13"), late), model))
    assert got.where("late").count() == 1
    want = run_lengths(df, keys=["series_id"], order="t", value="value", model=model)
    cols = ["series_id", "t", *NAMES]
    assert sorted(map(tuple, got.where("not late").select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
