from __future__ import annotations

import math
import random
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from tesora.operators import detect as dt
from tesora.operators.pelt import break_positions, pelt_breaks


def walk_cusum(x, h, drift, warmup):
    if len(x) <= warmup:
        return [False] * len(x)
    mu, sd = fmean(x[:warmup]), pstdev(x[:warmup]) or 1.0
    up = down = 0.0
    out = []
    for i, v in enumerate(x):
        if i < warmup:
            out.append(False)
            continue
        z = (v - mu) / sd
        up, down = max(0.0, up + z - drift), min(0.0, down + z + drift)
        out.append(up > h or -down > h)
    return out


def walk_page_hinkley(x, h, delta, warmup):
    if len(x) <= warmup:
        return [False] * len(x)
    mean = sum(x[:warmup]) / warmup
    p = q = pm = qm = 0.0
    out = [False] * warmup
    for i in range(warmup, len(x)):
        mean += (x[i] - mean) / (i + 1)
        p, q = p + x[i] - mean - delta, q - x[i] + mean - delta
        pm, qm = min(pm, p), min(qm, q)
        out.append(p - pm > h or q - qm > h)
    return out


def walk_states(points, c):
    level = above = below = 0
    out = []
    for score, conf in points:
        if score >= c.on_threshold:
            above, below = above + 1, 0
            level = max(level, 1)
            if above >= c.k_on:
                level = max(level, 2)
            if above >= c.break_persistence and conf >= c.min_confirmations:
                level = 3
        elif score < c.off_threshold:
            below, above = below + 1, 0
            if below >= c.k_off:
                level = 0
        else:
            below = 0
        out.append((dt.STATES[level], above, below))
    return out


def frame(spark, many):
    data = [(k, i, float(v)) for k, xs in many.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(data, "k string, t int, x double")


def random_series(seed, n=40):
    rng = random.Random(seed)
    many = {}
    for k in range(n):
        length = rng.randint(5, 50)
        shift = rng.choice([0, 0, 2.5, -2.5])
        many[f"s{k}"] = [rng.gauss(0, 1) + (shift if i > length // 2 else 0) for i in range(length)]
    many["flat"] = [1.0] * 20
    return many


def test_cusum_equals_the_recursion(spark):
    many = random_series(1)
    got = dt.cusum(frame(spark, many), keys=["k"], order="t", value="x", threshold=4.0137).collect()
    flags = {(r["k"], r["t"]): r["cusum_flag"] for r in got}
    for k, xs in many.items():
        assert [flags[k, i] for i in range(len(xs))] == walk_cusum(xs, 4.0137, 0.5, 12), k


def test_page_hinkley_equals_the_recursion(spark):
    many = random_series(2)
    many["step"] = [0.0] * 12 + [3.0] * 8
    got = dt.page_hinkley(frame(spark, many), keys=["k"], order="t", value="x", threshold=7.0137).collect()
    flags = {(r["k"], r["t"]): r["page_hinkley_flag"] for r in got}
    for k, xs in many.items():
        assert [flags[k, i] for i in range(len(xs))] == walk_page_hinkley(xs, 7.0137, 0.05, 12), k
    assert any(flags["step", i] for i in range(12, 20))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hysteresis_equals_the_machine(spark, seed):
    rng = random.Random(seed)
    c = dt.HysteresisConfig(2.0, 1.0, rng.randint(1, 3), rng.randint(1, 3), 3 + seed % 2, rng.randint(1, 2))
    many = {f"s{k}": [(rng.choice([0.5, 0.9, 1.5, 2.0, 2.5, 3.0]), rng.randint(0, 2)) for _ in range(60)] for k in range(30)}
    data = [(k, i, s, n) for k, xs in many.items() for i, (s, n) in enumerate(xs)]
    df = spark.createDataFrame(data, "k string, t int, score double, confirmations int")
    got = {(r["k"], r["t"]): r for r in dt.hysteresis(df, keys=["k"], order="t", config=c).collect()}
    for k, xs in many.items():
        want = walk_states(xs, c)
        assert [(got[k, i]["state"], got[k, i]["above_streak"], got[k, i]["below_streak"]) for i in range(60)] == want


def states(spark, points):
    df = spark.createDataFrame([("a", i, float(s), c) for i, (s, c) in enumerate(points)], "k string, t int, score double, confirmations int")
    return dt.hysteresis(df, keys=["k"], order="t").orderBy("t").collect()


def test_state_examples(spark):
    got = states(spark, [(2.2, 0), (2.3, 0), (1.5, 0), (0.8, 0), (0.7, 0)])
    assert [r["state"] for r in got] == ["OBSERVE", "WARNING", "WARNING", "WARNING", "NORMAL"]
    assert [r["reason_code"] for r in got] == ["CANDIDATE", "SUSTAINED", "BAND_ACTIVE", "RELEASE_PENDING", "RELEASED"]
    got = states(spark, [(2.2, 1), (2.3, 1), (2.5, 1), (2.6, 2)])
    assert [r["state"] for r in got][2:] == ["WARNING", "BREAK_CONFIRMED"]
    assert got[3]["reason"] == dt.REASONS["CONFIRMED"]


def test_bad_state_input_goes_aside(spark):
    bad = [(math.nan, 1.0), (math.inf, 1.0), (-1.0, 1.0), (1.0, 1.5), (1.0, -1.0), (None, 1.0)]
    df = spark.createDataFrame([("a", i, s, c) for i, (s, c) in enumerate([*bad, (1.0, 2.0)])], "k string, t int, score double, confirmations double")
    parts = dt.split_state_input(df)
    assert parts.clean.count() == 1 and parts.quarantine.count() == len(bad)
    with pytest.raises(ValueError):
        dt.HysteresisConfig(on_threshold=1.0, off_threshold=2.0)


def test_robust_scores(spark):
    df = frame(spark, {"a": [1, 2, 3, 4, 100], "b": [5, 5, 5, 5, 9], "c": [7, 7]})
    got = {(r["k"], r["t"]): r["z"] for r in dt.robust_standardize(df, keys=["k"], value="x").collect()}
    assert got["a", 2] == 0 and got["a", 3] == pytest.approx(1 / 1.4826)
    assert got["b", 4] == pytest.approx(4 / pstdev([5, 5, 5, 5, 9])) and got["c", 0] == 0


def test_alarm_matching_and_summary(spark):
    events = spark.createDataFrame([("a", 20, 3), ("b", 20, 6), ("c", 20, 6)], "k string, start int, duration int")
    alarms = spark.createDataFrame([("a", 25), ("b", 15), ("c", 29)], "k string, first_alarm int").withColumn("detector", F.lit("CUSUM"))
    got = {r["k"]: r for r in dt.match_alarms(alarms, events, keys=["k"]).collect()}
    assert got["a"]["detected"] and got["a"]["delay"] == 5 and got["a"]["event_type"] == "TRANSIENT_SHOCK"
    assert got["b"]["false_early"] and not got["b"]["detected"]
    assert not got["c"]["detected"] and got["c"]["event_type"] == "REGIME_SHIFT"
    breaks = spark.createDataFrame([("a", 3), ("a", 19), ("a", 24), ("b", 23), ("b", 23), ("d", 20)], "k string, break_pos int")
    near = {r["k"]: (r["localization_error"], r["detected"]) for r in dt.match_breaks(breaks, events, keys=["k"]).collect()}
    assert near == {"a": (1, True), "b": (3, False), "c": (None, False)}
    offline = dt.match_breaks(breaks, events, keys=["k"]).withColumn("detector", F.lit("PELT"))
    both = dt.match_alarms(alarms, events, keys=["k"]).unionByName(offline, allowMissingColumns=True)
    error = {(r["detector"], r["event_type"]): r["median_localization_error"] for r in dt.detection_summary(both).collect()}
    assert error["PELT", "REGIME_SHIFT"] == 3 and error["CUSUM", "REGIME_SHIFT"] is None
    out = {r["event_type"]: r for r in dt.detection_summary(dt.match_alarms(alarms, events, keys=["k"])).collect()}
    assert out["REGIME_SHIFT"]["false_early_rate"] == 0.5 and out["TRANSIENT_SHOCK"]["detection_rate"] == 1.0


def test_threshold_choice(spark):
    peaks = spark.createDataFrame([(float(v),) for v in (1, 4, 4.5, 6, 9, 11, 13, 2, 2, 40)], "peak double")
    out = dt.choose_threshold(peaks, candidates=dt.CUSUM_CANDIDATES, target_rate=0.2).first()
    assert (out["parameter"], out["null_path_fpr"], out["target_met"]) == (12.0, 0.2, True)
    out = dt.choose_threshold(peaks, candidates=(1.0, 2.0), target_rate=0.1).first()
    assert out["parameter"] == 2.0 and not out["target_met"]
    series = spark.createDataFrame([(c,) for c in "abcd"], "k string")
    breaks = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, 5), ("b", 1.0, 9), ("b", 1.0, 12), ("c", 1.0, 4)], "k string, penalty double, break_pos int")
    out = dt.choose_penalty(series, breaks, keys=["k"], candidates=(1.0, 3.0, 5.0), target_rate=0.3).first()
    assert (out["parameter"], out["null_path_fpr"], out["target_met"]) == (3.0, 0.25, True)


def test_probability_state(spark):
    data = [("a", "x", 0.43), ("a", "y", 0.41), ("a", "z", 0.16), ("b", "x", 0.7), ("b", "y", 0.3), ("c", "x", 1.0), ("d", "x", 0.5), ("d", "y", 0.5)]
    df = spark.createDataFrame(data, "k string, label string, p double")
    got = {r["k"]: r["state"] for r in dt.probability_state(df, keys=["k"], label="label", probability="p").collect()}
    assert got == {"a": "UNCERTAIN", "b": "x", "c": "x", "d": "UNCERTAIN"}


def test_breaks(spark):
    rng = random.Random(5)
    x = [rng.gauss(0, 0.3) for _ in range(30)] + [rng.gauss(5, 0.3) for _ in range(30)]
    assert break_positions(x, 3.0) == [30]
    assert break_positions([rng.gauss(0, 1) for _ in range(40)], 100.0) == []
    assert break_positions([1.0, 2.0], 3.0) == []
    df = frame(spark, {"a": x, "b": [1.0] * 20})
    got = pelt_breaks(df, keys=["k"], order="t", value="x").collect()
    assert [(r["k"], r["break_pos"]) for r in got] == [("a", 30)]


def test_confirmations(spark):
    flagged = frame(spark, {"a": [0] * 6}).withColumns({"pos": F.col("t"), "cusum_flag": F.col("t") >= 3})
    breaks = spark.createDataFrame([("a", 3), ("a", 4)], "k string, break_pos int")
    got = dt.confirmations(flagged, breaks, keys=["k"]).orderBy("pos").collect()
    assert [r["confirmations"] for r in got] == [0, 0, 1, 2, 2, 2]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_blocks_change_nothing(spark, size):
    many = random_series(6, n=8)
    df = frame(spark, many).withColumn("part", F.floor(F.col("t") / size))
    by = dict(keys=["k"], order="t")
    for run, cols in (
        (lambda **kw: dt.cusum(df, value="x", **by, **kw), ("cusum_up", "cusum_down")),
        (lambda **kw: dt.page_hinkley(df, value="x", **by, **kw), ("ph_up", "ph_down")),
    ):
        whole = {(r["k"], r["t"]): r for r in run().collect()}
        for r in run(block="part").collect():
            for c in cols:
                assert r[c] == pytest.approx(whole[r["k"], r["t"]][c], abs=1e-9)
    scored = df.withColumns({"score": F.abs("x") * 1.3, "confirmations": F.lit(2)})
    cols = ("k", "t", "state", "above_streak", "below_streak", "reason_code")
    whole = dt.hysteresis(scored, **by).select(*cols).collect()
    cut = dt.hysteresis(scored, block="part", **by).select(*cols).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut))


def test_pruned_breaks_equal_the_full_search():
    import numpy as np

    from tesora.operators import pelt

    def full(x, penalty):
        n, p = len(x), pelt._kernel_sums(np.asarray(x, dtype=float))
        cost = lambda a, b: (b - a) - (p[b, b] - p[a, b] - p[b, a] + p[a, a]) / (b - a)
        ends = [e for e in range(0, n, pelt.JUMP) if e >= pelt.MIN_SIZE] + [n]
        best = {0: (0.0, [])}
        for e in ends:
            best[e] = min((best[s][0] + cost(s, e) + penalty, best[s][1] + [s]) for s in best if e - s >= pelt.MIN_SIZE)
        return best[n][0], [b for b in best[n][1] if b]

    for seed in range(20):
        rng = random.Random(seed)
        x = [rng.gauss(rng.choice([0, 0, 3]) if i % 15 == 0 else 0, 1) + (2 if i > 30 else 0) for i in range(60)]
        assert break_positions(x, 1.0) == full(x, 1.0)[1], seed


def test_long_series_write_once_and_keep_null_keys(spark, monkeypatch):
    data = [(k, t, math.sin(t) + 4 * (t > 25)) for k in ("a", None) for t in range(50)]
    df = spark.createDataFrame(data, "k string, t int, x double").withColumn("part", F.floor(F.col("t") / 4)).repartition(3)
    written = []
    for name, run, cols in (
        ("cusum", lambda d, **b: dt.cusum(d, keys=["k"], order="t", value="x", **b), ["k", "t", "pos", "cusum_up", "cusum_down", "cusum_flag"]),
        ("page_hinkley", lambda d, **b: dt.page_hinkley(d, keys=["k"], order="t", value="x", **b), ["k", "t", "pos", "ph_up", "ph_down", "page_hinkley_flag"]),
        (
            "hysteresis",
            lambda d, **b: dt.hysteresis(d.withColumns({"score": F.abs("x"), "confirmations": F.lit(2)}), keys=["k"], order="t", **b),
            ["k", "t", "state", "above_streak", "below_streak"],
        ),
    ):
        want = {tuple(r)[:2]: tuple(r)[2:] for r in run(df).select(*cols).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(dt, "materialize", lambda d, purpose, name=name: written.append(name) or d)
            got = {tuple(r)[:2]: tuple(r)[2:] for r in run(df, block="part").select(*cols).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) if name != "hysteresis" else got[k] == want[k] for k in want)
    assert written == ["cusum", "page_hinkley", "hysteresis"]


@pytest.mark.parametrize("descending", [False, True])
def test_events_of_one_moment_stand_in_the_order_of_their_ids(spark, tmp_path, descending):
    from datetime import datetime, timedelta

    from tesora.plans.inputs import SCHEMAS
    from tesora.plans.registry import REGISTRY

    rng = random.Random(5)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i // 4), 1, "view", float(rng.choice([10, 12, 30, 48, 70])), "") for i in range(240)]
    stored = sorted(rows, reverse=descending)
    spark.createDataFrame(stored, SCHEMAS["events"]).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = REGISTRY["event_states"].build(spark, str(tmp_path)).select("ts", "state", "above_streak", "below_streak").collect()
    mu, sd = fmean(r[4] for r in rows[:12]), pstdev(r[4] for r in rows[:12])
    want = walk_states([(abs(r[4] - mu) / sd, 2 if r[4] > 50 else 1) for r in rows], dt.HysteresisConfig())
    assert sorted(map(tuple, got)) == sorted((r[1], *w) for r, w in zip(rows, want, strict=True))
