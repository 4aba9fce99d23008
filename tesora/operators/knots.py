"""Knots of trend and season by model averaging: the chance that a series starts anew at each point.

A series is cut into segments at unknown knots. Inside a segment the standardised
values follow one of four structures: a level, a level with a slope, and either
of them with seasonal waves. Coefficients and noise are integrated out, so a
segment has an evidence under each structure, and the result averages over all
structures of all segments and over all sets of knots, weighted by posterior
chance; no knot set is searched for or sampled. Trend and season start anew at
the same knots.

Time counts from a segment's start. A shift of time only rotates each pair of
waves, whose prior does not change under rotation, so the design of a segment
depends on its length alone and is factored once a length, not once a segment.
The sum over knot sets is a recursion forwards and one backwards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRUCTURES = ("level", "slope", "level_season", "slope_season")


@dataclass(frozen=True)
class KnotModel:
    """Prior: a knot once in ``expected_run`` points; coefficients of ``scale`` noise deviations; inverse gamma noise."""

    expected_run: float = 24.0
    season: int = 12
    waves: int = 1
    scale: float = 3.0
    shape: float = 1.0
    rate: float = 0.5
    structures: tuple[str, ...] = STRUCTURES

    def __post_init__(self) -> None:
        if self.expected_run <= 1 or min(self.scale, self.shape, self.rate) <= 0:
            raise ValueError("expected_run must be above 1; scale, shape and rate must be positive")
        if self.season < 3 or not 1 <= self.waves < self.season / 2:
            raise ValueError("a season has at least three points, and less than half as many waves")
        if not self.structures or set(self.structures) - set(STRUCTURES):
            raise ValueError(f"structures must be some of {', '.join(STRUCTURES)}")

    def columns(self, structure: str) -> list[int]:
        """Columns of the design that a structure uses: level, slope, then sine and cosine of each wave."""
        slope = [1] if structure.startswith("slope") else []
        season = list(range(2, 2 + 2 * self.waves)) if structure.endswith("season") else []
        return [0, *slope, *season]

    def design(self, n: int) -> np.ndarray:
        at = np.arange(n)
        turns = [2 * math.pi * k * at / self.season for k in range(1, self.waves + 1)]
        return np.stack([np.ones(n), at / self.season, *[f(t) for t in turns for f in (np.sin, np.cos)]], axis=1)


@lru_cache(maxsize=16)
def _factors(model: KnotModel, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each structure and segment length: posterior covariance, and half the change of its log determinant."""
    x = model.design(n)
    found = []
    for structure in model.structures:
        z = x[:, model.columns(structure)]
        width = z.shape[1]
        precision = np.cumsum(z[:, :, None] * z[:, None, :], axis=0) + np.eye(width) / model.scale**2
        half = -0.5 * np.linalg.slogdet(precision)[1] - width * math.log(model.scale)
        found.append((np.linalg.inv(precision), half))
    return found


def _log_sum(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _evidence(y: np.ndarray, model: KnotModel) -> np.ndarray:
    """Log evidence (structure, start, length - 1) of all segments; minus infinity beyond the end."""
    n = len(y)
    x, factors = model.design(n), _factors(model, n)
    lengths = np.arange(1, n + 1)
    shape = model.shape + lengths / 2
    gammas = np.array([math.lgamma(a) for a in shape.tolist()]) - math.lgamma(model.shape)
    constant = gammas + model.shape * math.log(model.rate) - lengths / 2 * math.log(2 * math.pi)
    out = np.full((len(factors), n, n), -np.inf)
    for start in range(n):
        part = y[start:]
        m = len(part)
        products, squares = np.cumsum(x[:m] * part[:, None], axis=0), np.cumsum(part * part)
        for i, (structure, (cover, half)) in enumerate(zip(model.structures, factors, strict=True)):
            b = products[:, model.columns(structure)]
            explained = np.einsum("li,lij,lj->l", b, cover[:m], b)
            rate = model.rate + np.maximum(squares - explained, 0) / 2
            out[i, start, :m] = constant[:m] + half[:m] - shape[:m] * np.log(rate)
    return out - math.log(len(factors))


def knot_posterior(values: Sequence[float], model: KnotModel = KnotModel()) -> dict[str, np.ndarray]:
    """p_knot, p_slope and p_season of every point of one series, and the log evidence of the whole series.

    ``p_knot`` is the chance that a segment other than the first starts at the
    point; ``p_slope`` and ``p_season`` that the point's segment has one.
    """
    raw = np.asarray(values, float)
    n = len(raw)
    deviation = float(raw.std()) if n else 0.0
    y = (raw - raw.mean()) / (deviation or 1.0) if n else raw
    if not n:
        return {k: np.empty(0) for k in ("p_knot", "p_slope", "p_season", "log_evidence")}
    each = _evidence(y, model)
    stay, cut = math.log1p(-1 / model.expected_run), -math.log(model.expected_run)
    total = _log_sum(each, axis=0)
    segment = total + stay * np.arange(n)
    segment[1:] += cut
    by_end = np.full((n, n + 1), -np.inf)  # start, end
    for start in range(n):
        by_end[start, start + 1 :] = segment[start, : n - start]
    ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = back[n] = 0.0
    for end in range(1, n + 1):
        ahead[end] = _log_sum(ahead[:end] + by_end[:end, end])
    for start in range(n - 1, -1, -1):
        back[start] = _log_sum(by_end[start, start + 1 :] + back[start + 1 :])
    weight = np.exp(ahead[:n, None] + by_end + back[None, :] - ahead[n])  # of the segment from start to end
    knot = weight.sum(axis=1)
    knot[0] = 0.0
    shares = {"p_slope": np.zeros(n), "p_season": np.zeros(n)}
    for i, structure in enumerate(model.structures):
        share = np.zeros((n, n + 1))
        for start in range(n):
            share[start, start + 1 :] = np.exp(each[i, start, : n - start] - total[start, : n - start])
        of_it = weight * share
        inside = np.cumsum(of_it.sum(axis=1) - of_it.sum(axis=0)[:n])  # begun here, less ended before
        shares["p_slope"] += inside * structure.startswith("slope")
        shares["p_season"] += inside * structure.endswith("season")
    clipped = {k: np.clip(v, 0.0, 1.0) for k, v in shares.items()}
    return {"p_knot": np.clip(knot, 0.0, 1.0), **clipped, "log_evidence": np.full(n, ahead[n])}


def knots(df: DataFrame, *, keys: Sequence[str], order: str, value: str, model: KnotModel = KnotModel()) -> DataFrame:
    """(keys, order, p_knot, p_slope, p_season, log_evidence) of every row with a finite value.

    A series is one group, bounded by its calendar: the work is quadratic in its
    length. Points are counted in order, so the calendar should be complete;
    equal times are taken by value. A constant series is one of zeros.
    """
    number = F.col(value).cast("double")
    usable = df.where(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != math.inf)).select(*keys, order, number.alias("_x"))
    names = [*keys, order]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([order, "_x"], kind="stable")
        return part[names].assign(**knot_posterior(part["_x"].to_numpy(), model))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.schema if f.name != "_x")
    return usable.groupBy(*keys).applyInPandas(run, f"{kept}, p_knot double, p_slope double, p_season double, log_evidence double")


def knot_alarms(found: DataFrame, *, keys: Sequence[str], order: str, threshold: float = 0.5) -> DataFrame:
    """One row per series: expected knots, knots at or above the threshold, the likeliest place and its chance."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    return found.groupBy(*keys).agg(
        F.sum("p_knot").alias("expected_knots"),
        F.count_if(F.col("p_knot") >= threshold).alias("n_knots"),
        F.max("p_knot").alias("top_p"),
        F.min_by(order, F.struct(-F.round("p_knot", 9), order)).alias("top_at"),
    )
