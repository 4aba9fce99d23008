from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from tesora.operators.knots import STRUCTURES, KnotModel, knot_alarms, knot_posterior, knots


def plain_evidence(y, start, structure, m):
    """Student density of a segment by its whole covariance matrix, with time counted from the series' start for the waves."""
    n = len(y)
    rows = []
    for i in range(n):
        row = [1.0]
        if structure.startswith("slope"):
            row.append(i / m.season)
        if structure.endswith("season"):
            for k in range(1, m.waves + 1):
                turn = 2 * math.pi * k * (start + i) / m.season
                row += [math.cos(turn), math.sin(turn)]
        rows.append(row)
    x = np.array(rows)
    cover = (m.rate / m.shape) * (np.eye(n) + m.scale**2 * x @ x.T)
    df = 2 * m.shape
    squared = float(y @ np.linalg.solve(cover, y))
    return (
        math.lgamma((df + n) / 2) - math.lgamma(df / 2) - n / 2 * math.log(df * math.pi)
        - 0.5 * np.linalg.slogdet(cover)[1] - (df + n) / 2 * math.log1p(squared / df)
    )


def plain_posterior(values, m):
    """All knot sets and all structures of their segments, one by one."""
    raw = np.array(values, float)
    y = (raw - raw.mean()) / (raw.std() or 1)
    n, q = len(y), 1 / m.expected_run
    found = {k: np.zeros(n) for k in ("p_knot", "p_slope", "p_season")}
    whole = 0.0
    for cuts in itertools.product((0, 1), repeat=n - 1):
        places = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        prior = math.prod(q if c else 1 - q for c in cuts)
        chance, slope, season = prior, np.zeros(n), np.zeros(n)
        for a, b in itertools.pairwise(places):
            each = {s: math.exp(plain_evidence(y[a:b], a, s, m)) / len(m.structures) for s in m.structures}
            total = sum(each.values())
            chance *= total
            slope[a:b] = sum(v for s, v in each.items() if s.startswith("slope")) / total
            season[a:b] = sum(v for s, v in each.items() if s.endswith("season")) / total
        whole += chance
        found["p_knot"][places[1:-1]] += chance
        found["p_slope"] += chance * slope
        found["p_season"] += chance * season
    return {k: v / whole for k, v in found.items()} | {"log_evidence": np.full(n, math.log(whole))}


@pytest.mark.parametrize("model", [KnotModel(season=4), KnotModel(5.0, 6, 2, 1.5, 2.0, 0.3), KnotModel(8.0, structures=("level",))])
def test_posterior_equals_the_sum_over_all_knot_sets(model):
    rng = random.Random(3)
    for values in ([rng.gauss(i // 4 * 3, 1) for i in range(9)], [2.0], [1.0, 1.0, 1.0], [0.0, 5.0]):
        want, got = plain_posterior(values, model), knot_posterior(values, model)
        for name, column in want.items():
            assert got[name].tolist() == pytest.approx(column.tolist(), rel=1e-7, abs=1e-10)


def test_a_shift_a_slope_and_a_season_are_seen():
    rng = random.Random(4)
    shift = knot_posterior([rng.gauss(0 if i < 30 else 6, 1) for i in range(60)])
    assert shift["p_knot"].argmax() == 30 and shift["p_knot"][30] > 0.9 and shift["p_knot"].sum() < 2
    slope = knot_posterior([0.5 * i + rng.gauss(0, 1) for i in range(48)])
    assert slope["p_slope"].min() > 0.9 and slope["p_knot"].max() < 0.2
    season = knot_posterior([5 * math.sin(i * math.pi / 6) + rng.gauss(0, 1) for i in range(60)])
    assert season["p_season"].min() > 0.9 and season["p_knot"].max() < 0.2


def test_long_flat_and_large_values_stay_finite():
    for values in ([7.0] * 200, [1e12 + i % 3 for i in range(150)], []):
        got = knot_posterior(values)
        assert all(np.isfinite(v).all() and len(v) == len(values) for v in got.values())


def test_series_apart_in_any_row_order_without_unusable_values(spark):
    rng = random.Random(5)
    rows = [("a", i, rng.gauss(0 if i < 20 else 8, 1)) for i in range(40)] + [(None, i, float(i % 2)) for i in range(12)]
    bad = [("a", 99, None), ("a", 98, float("nan")), ("b", 1, float("inf")), ("c", 1, 3.0)]
    shuffled = random.Random(6).sample(rows + bad, len(rows) + len(bad))
    df = spark.createDataFrame(shuffled, "k string, t int, x double")
    out = knots(df, keys=["k"], order="t", value="x")
    found = {(r.k, r.t): r.p_knot for r in out.collect()}
    assert set(found) == {(k, t) for k, t, _ in rows} | {("c", 1)}
    want = knot_posterior([x for k, _, x in rows if k == "a"])["p_knot"].tolist()
    assert [found["a", t] for t in range(40)] == pytest.approx(want)
    top = {r.k: (r.n_knots, r.top_at) for r in knot_alarms(out, keys=["k"], order="t").collect()}
    assert top["a"] == (1, 20) and top["c"] == (0, 1)
    assert knots(df.limit(0), keys=["k"], order="t", value="x").count() == 0


@pytest.mark.parametrize("wrong", [{"expected_run": 1.0}, {"scale": 0.0}, {"season": 2}, {"waves": 6}, {"structures": ()}, {"structures": ("cubic",)}])
def test_wrong_settings(wrong):
    with pytest.raises(ValueError):
        KnotModel(**wrong)
    assert len(STRUCTURES) == 4
