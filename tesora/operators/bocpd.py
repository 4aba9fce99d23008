"""Bayesian online change points: the posterior of the time since the last change, point by point.

Every series has a normal model with unknown mean and variance that starts anew
at a change, and a change has the same chance ``1 / expected_run`` at every
point. The chance of a point under a run of known length is then a Student
density of that run's count, mean and squared deviations, so a step updates a
few arrays and costs as much as there are run lengths.

Run lengths are pruned: each step drops the least likely ones whose posterior
adds up to at most ``tolerance``. That total is the variation distance between
the posterior before and after the cut, and ``lost`` carries the sum of all cuts
so far; with a tolerance of zero nothing is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that the detector adds, all of type double but the counts and the flag.
OUTPUT = "pos long, run_length long, p_recent double, log_predictive double, kept int, lost double, bocpd_flag boolean"
NAMES = [f.split()[0] for f in OUTPUT.split(", ")]


@dataclass(frozen=True)
class RunLengthModel:
    """Prior of a segment's mean and variance, chance of a change, and when a row counts as an alarm.

    A row is flagged when the chance that the last change lies at most
    ``recent`` points back exceeds ``threshold``, after the first ``warmup`` rows.
    """

    mean: float = 0.0
    strength: float = 1.0
    shape: float = 1.0
    rate: float = 1.0
    expected_run: float = 24.0
    tolerance: float = 1e-12
    recent: int = 3
    threshold: float = 0.5
    warmup: int = 12

    def __post_init__(self) -> None:
        if min(self.strength, self.shape, self.rate) <= 0 or self.expected_run <= 1:
            raise ValueError("strength, shape and rate must be positive, expected_run above 1")
        if not 0 <= self.tolerance < 1 or not 0 < self.threshold <= 1 or self.recent < 0 or self.warmup < 0:
            raise ValueError("tolerance must be in [0, 1), threshold in (0, 1], recent and warmup not negative")


@dataclass
class RunLengths:
    """State of one series: probability, mean and squared deviations of every run length still kept."""

    model: RunLengthModel
    seen: int = 0
    lost: float = 0.0
    runs: np.ndarray = field(default_factory=lambda: np.zeros((4, 1)) + np.array([[0.0], [1.0], [0.0], [0.0]]))

    def step(self, x: float) -> tuple:
        """Fold one point; returns the values of ``OUTPUT``."""
        m = self.model
        n, p, mean, m2 = self.runs
        strength, shape = m.strength + n, m.shape + n / 2
        rate = m.rate + m2 / 2 + m.strength * n * (mean - m.mean) ** 2 / (2 * strength)
        centre = (m.strength * m.mean + n * mean) / strength
        spread = rate * (strength + 1) / (shape * strength)
        scaled = np.log1p((x - centre) ** 2 / (2 * shape * spread))
        constant = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in shape.tolist()])
        log_density = constant - 0.5 * np.log(2 * math.pi * shape * spread) - (shape + 0.5) * scaled
        top = float(log_density.max())
        joint = p * np.exp(log_density - top)
        total = float(joint.sum())
        hazard = 1 / m.expected_run
        joint /= total
        step = x - mean
        new_mean = mean + step / (n + 1)
        grown = np.stack([n + 1, joint * (1 - hazard), new_mean, m2 + step * (x - new_mean)])
        runs = np.concatenate([np.array([[0.0], [hazard], [0.0], [0.0]]), grown], axis=1)
        order = np.argsort(runs[1], kind="stable")
        cut = int(np.searchsorted(np.cumsum(runs[1][order]), m.tolerance, "right")) if m.tolerance else 0
        if cut:
            dropped = float(runs[1][order[:cut]].sum())
            runs = np.delete(runs, order[:cut], axis=1)
            runs[1] /= 1 - dropped
            self.lost += dropped
        self.runs = runs
        position, self.seen = self.seen, self.seen + 1
        recent = float(runs[1][runs[0] <= m.recent].sum())
        flag = position >= m.warmup and recent > m.threshold
        return position, int(runs[0][np.argmax(runs[1])]), recent, top + math.log(total), runs.shape[1], self.lost, flag

    def dump(self) -> bytes:
        return self.runs.tobytes()

    @classmethod
    def load(cls, model: RunLengthModel, seen: int, lost: float, runs: bytes) -> RunLengths:
        return cls(model, seen, lost, np.frombuffer(runs).reshape(4, -1).copy())


def run_lengths(df: DataFrame, *, keys: Sequence[str], order: str, value: str, model: RunLengthModel = RunLengthModel()) -> DataFrame:
    """Every row with a finite value, with the run-length columns of its series up to it.

    Rows are dealt by series and sorted, and a task folds them one after another:
    it holds the state of one series, never its rows, so length does not matter
    for memory. The recursion is sequential along a series; a series that is too
    long for one task belongs into the stream (:func:`tesora.streaming.online.run_length_stream`).
    """
    number = F.col(value).cast("double")
    usable = df.where(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != math.inf)).withColumn("_x", number)
    dealt = usable.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, order)
    names, fields = df.columns, dealt.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, RunLengths(model)
        for batch in batches:
            found = []
            for *key, x in zip(*[batch.column(c).to_pylist() for c in (*keys, "_x")], strict=True):
                if key != current:
                    current, state = key, RunLengths(model)
                found.append(state.step(x))
            added = [pa.array(c) for c in zip(*found, strict=True)] if found else [pa.array([], pa.null())] * len(NAMES)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.bool_())
            added = [a.cast(t) for a, t in zip(added, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *added], [*names, *NAMES])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name != "_x")
    return dealt.mapInArrow(fold, f"{kept}, {OUTPUT}")
