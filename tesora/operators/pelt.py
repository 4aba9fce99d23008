"""Offline change points: penalised optimal segmentation with a kernel cost, one series per group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of the published method's common implementation.
MIN_SIZE = 2
JUMP = 5


def _kernel_sums(x: np.ndarray) -> np.ndarray:
    """Two-dimensional prefix sums of the Gaussian kernel; the bandwidth is the median squared distance."""
    d = np.square(x[:, None] - x[None, :])
    upper = d[np.triu_indices(len(x), 1)]
    scale = float(np.median(upper)) if len(upper) else 0.0
    if scale > 0:
        d = d / scale
    k = np.exp(-np.clip(d, 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    out = np.zeros((len(x) + 1, len(x) + 1))
    out[1:, 1:] = k.cumsum(0).cumsum(1)
    return out


def break_positions(x: np.ndarray, penalty: float, min_size: int = MIN_SIZE, jump: int = JUMP, sums: np.ndarray | None = None) -> list[int]:
    """Starts of new segments; candidate ends lie on the ``jump`` grid, pruned by the cost bound.

    ``sums`` are the series' kernel sums, where several penalties are searched.
    """
    n = len(x)
    if n < 2 * min_size:
        return []
    p = _kernel_sums(np.asarray(x, dtype=float)) if sums is None else sums

    def cost(a: int, b: int) -> float:
        return (b - a) - (p[b, b] - p[a, b] - p[b, a] + p[a, a]) / (b - a)

    ends = [e for e in range(0, n, jump) if e >= min_size] + [n]
    best: dict[int, tuple[float, int]] = {0: (0.0, -1)}
    open_starts: list[int] = []
    for end in ends:
        open_starts.append((end - min_size) // jump * jump)
        tried = [(best[s][0] + cost(s, end) + penalty, s) for s in open_starts if s in best]
        best[end] = min(tried)
        limit = best[end][0] + penalty
        open_starts = [s for total, s in tried if total <= limit]
    out, at = [], n
    while best[at][1] > 0:
        at = best[at][1]
        out.append(at)
    return sorted(out)


def pelt_breaks(
    df: DataFrame, *, keys: Sequence[str], order: str, value: str, penalties: Sequence[float] = (3.0,)
) -> DataFrame:
    """``(keys, penalty, break_pos)`` for every series and penalty.

    A series has one row per period (see ``panel``), which bounds a group by the
    calendar; the work is quadratic in that length and parallel over series.
    """
    wanted = [float(q) for q in penalties]
    slim = df.select(*keys, F.col(order).alias("_t"), F.col(value).cast("double").alias("_x"))
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keys)])

    def per_series(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("_t")["_x"].to_numpy()
        sums = _kernel_sums(x)  # the same for all penalties
        found = [(*key, q, int(b)) for q in wanted for b in break_positions(x, q, sums=sums)]
        return pd.DataFrame(found, columns=[*keys, "penalty", "break_pos"])

    return slim.groupBy(*keys).applyInPandas(per_series, f"{key_fields}, penalty double, break_pos int")
