"""Change-point alarms, hysteresis states and their evaluation, without row-by-row recursion.

The recursions have closed forms over running sums and running extremes. A series
with one row per period is bounded by the calendar and runs in one window; a long
one (events, readings) names a ``block`` column and is spread over many tasks, see
``prefix.running``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import first_reason, safe_ratio
from tesora.operators.contracts import Split
from tesora.operators.prefix import carried, inside, met, running
from tesora.session import materialize

# State names by level and the reason texts of a state update.
STATES = ("NORMAL", "OBSERVE", "WARNING", "BREAK_CONFIRMED")
REASONS = {
    "CONFIRMED": "устойчивый сигнал подтвержден независимыми детекторами",
    "SUSTAINED": "устойчивое превышение порога",
    "CANDIDATE": "кандидат на аномалию, продолжаем наблюдение",
    "RELEASED": "сигнал снят после выполнения hysteresis rule",
    "RELEASE_PENDING": "ниже порога снятия, ждем подтверждения по времени",
    "BAND_NORMAL": "внутри hysteresis band",
    "BAND_OBSERVE": "кандидат остается внутри hysteresis band",
    "BAND_ACTIVE": "активный сигнал сохраняется внутри hysteresis band",
}
# Threshold candidates of the calibration.
CUSUM_CANDIDATES = (3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 15.0, 20.0, 30.0)
PAGE_HINKLEY_CANDIDATES = (3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0, 30.0)
PELT_CANDIDATES = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0, 100.0)
MAD_TO_SIGMA = 1.4826


# ---- standardisation ---------------------------------------------------------


def robust_standardize(df: DataFrame, *, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(x - median) / (1.4826 MAD); a zero MAD falls back to the population deviation, then to 1."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med"), F.stddev_pop(value).alias("sd"))
    centred = df.join(med, list(keys))
    mad = centred.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    scale = (
        F.when(F.col("mad") != 0, F.col("mad") * MAD_TO_SIGMA).when(F.col("sd") != 0, F.col("sd")).otherwise(F.lit(1.0))
    )
    return centred.join(mad, list(keys)).withColumn(out, (F.col(value) - F.col("med")) / scale).drop("med", "sd", "mad")


def _numbered(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], block: str | None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Rows with their position and the running ``sums``.

    A long series is read once for the totals of its blocks, one row each; its
    rows are numbered inside the block and nothing is written.
    """
    df, sums = df.drop("pos"), sums or {}
    if block is None:
        df = running(df, {"pos": ("sum", F.lit(1)), **{n: ("sum", c) for n, c in sums.items()}}, keys=keys, order=order)
        return df.withColumn("pos", (F.col("pos") - 1).cast("int"))
    totals = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = carried(totals, {"n": "sum", **{n: "sum" for n in sums}}, keys=keys, block=block).drop("n", *sums)
    here = inside(keys, block, order)
    rows = met(df, offsets, [*keys, block]).withColumn("_l_n", F.row_number().over(here))
    rows = rows.withColumns({n: F.sum(c).over(here) + F.coalesce(f"_c_{n}", F.lit(0.0)) for n, c in sums.items()})
    pos = (F.coalesce("_c_n", F.lit(0)) + F.col("_l_n") - 1).cast("int")
    return rows.withColumn("pos", pos).drop("_l_n", "_c_n", *[f"_c_{n}" for n in sums])


def baseline_standardize(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: str | Sequence[str],
    value: str,
    warmup: int = 12,
    out: str = "z",
    block: str | None = None,
) -> DataFrame:
    """Position in the series and score against mean and population deviation of the first rows."""
    rows = df
    df = _numbered(df, keys, order, block)
    if block is None:
        first = F.when(F.col("pos") < warmup, F.col(value))
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumns({"_mu": F.avg(first).over(whole), "_sd": F.stddev_pop(first).over(whole)})
    else:
        # only the first blocks hold warm-up rows: numbering starts again from those alone
        first = rows.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("n"))
        first = carried(first, {"n": "sum"}, keys=keys, block=block).where(F.coalesce("_c_n", F.lit(0)) < warmup)
        early = met(rows, first.select(*keys, block, F.lit(True).alias("_early")), [*keys, block]).where("_early").drop("_early")
        head = _numbered(early, keys, order, block).where(F.col("pos") < warmup)
        base = head.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
        df = met(df, base, keys)
    sd = F.when(F.col("_sd") != 0, F.col("_sd")).otherwise(F.lit(1.0))
    return df.withColumn(out, (F.col(value) - F.col("_mu")) / sd).drop("_mu", "_sd")


# ---- online detectors --------------------------------------------------------


def cusum(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: str | Sequence[str],
    value: str,
    threshold: float = 5.0,
    drift: float = 0.5,
    warmup: int = 12,
    block: str | None = None,
) -> DataFrame:
    """Two-sided CUSUM: adds ``pos``, ``z``, ``cusum_up``, ``cusum_down`` and ``cusum_flag``.

    ``up = S - min(0, min S)`` with S the running sum of ``z - drift`` after the
    warm-up; the mirrored form gives the lower side. A series no longer than the
    warm-up gets no alarm.
    """
    if warmup < 2:
        return df.withColumns({"cusum_flag": F.lit(False)})
    along = {"keys": keys, "order": order, "block": block}
    df = baseline_standardize(df, value=value, warmup=warmup, **along)
    live = F.col("pos") >= warmup
    steps = {"cusum_up": (F.col("z") - drift, "min"), "cusum_down": (F.col("z") + drift, "max")}
    df = _above_extreme(df, {n: (F.when(live, c).otherwise(0.0), how) for n, (c, how) in steps.items()}, **along)
    flag = live & ((F.col("cusum_up") > threshold) | (F.abs("cusum_down") > threshold))
    return df.withColumn("cusum_flag", flag)


def _above_extreme(df: DataFrame, steps: dict[str, tuple[Column, str]], *, keys: Sequence[str], order: str | Sequence[str], block: str | None) -> DataFrame:
    """For each step the running sum less its lowest ("min") or highest ("max") value so far, zero included.

    A block's state is its sum and its extreme running sum; the states of
    earlier blocks compose to a sum and an extreme. So a long series is windowed
    and written once, and its rows meet the carried state of their block.
    """
    pick = {"min": (F.min, F.least), "max": (F.max, F.greatest)}
    here = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0) if block is None else inside(keys, block, order)
    df = df.withColumns({f"_d_{n}": c for n, (c, _) in steps.items()})
    df = df.withColumns({f"_s_{n}": F.sum(f"_d_{n}").over(here) for n in steps})
    df = df.withColumns({f"_e_{n}": pick[how][0](f"_s_{n}").over(here) for n, (_, how) in steps.items()})
    zero = F.lit(0.0)
    if block is None:
        df = df.withColumns({n: F.col(f"_s_{n}") - pick[how][1](zero, f"_e_{n}") for n, (_, how) in steps.items()})
    else:
        df = materialize(df, "block_states")
        totals = df.groupBy(*keys, block).agg(
            *[F.sum(f"_d_{n}").alias(f"s_{n}") for n in steps], *[pick[how][0](f"_s_{n}").alias(f"e_{n}") for n, (_, how) in steps.items()]
        )
        states = carried(totals, {f"s_{n}": "sum" for n in steps}, keys=keys, block=block)
        states = states.withColumns({f"e_{n}": F.col(f"e_{n}") + F.coalesce(f"_c_s_{n}", zero) for n in steps})
        states = carried(states, {f"e_{n}": how for n, (_, how) in steps.items()}, keys=keys, block=block)
        df = met(df, states.select(*keys, block, *[f"_c_{mark}_{n}" for n in steps for mark in "se"]), [*keys, block])
        before = {n: F.coalesce(f"_c_s_{n}", zero) for n in steps}
        df = df.withColumns(
            {
                n: before[n] + F.col(f"_s_{n}") - pick[how][1](zero, before[n] + F.col(f"_e_{n}"), F.coalesce(f"_c_e_{n}", zero))
                for n, (_, how) in steps.items()
            }
        )
    return df.drop(*[f"{mark}_{n}" for n in steps for mark in ("_d", "_s", "_e", "_c_s", "_c_e")])


def page_hinkley(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: str | Sequence[str],
    value: str,
    threshold: float = 8.0,
    delta: float = 0.05,
    warmup: int = 12,
    block: str | None = None,
) -> DataFrame:
    """Two-sided Page-Hinkley against the running mean of all points so far."""
    if warmup < 2:
        return df.withColumns({"page_hinkley_flag": F.lit(False)})
    along = {"keys": keys, "order": order, "block": block}
    df = _numbered(df, keys, order, block, {"_sum": F.col(value)})
    live = F.col("pos") >= warmup
    step = F.col(value) - F.col("_sum") / (F.col("pos") + 1)
    steps = {"ph_up": (F.when(live, step - delta).otherwise(0.0), "min"), "ph_down": (F.when(live, -step - delta).otherwise(0.0), "min")}
    df = _above_extreme(df, steps, **along)
    flag = live & ((F.col("ph_up") > threshold) | (F.col("ph_down") > threshold))
    return df.withColumn("page_hinkley_flag", flag).drop("_sum")


def first_alarm(df: DataFrame, *, keys: Sequence[str], flag: str, at: str = "pos") -> DataFrame:
    """First flagged position per series; NULL without an alarm."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(flag), F.col(at))).alias("first_alarm"))


def confirmations(
    flagged: DataFrame, breaks: DataFrame, *, keys: Sequence[str], flag: str = "cusum_flag", near: int = 1
) -> DataFrame:
    """Confirmations per row: the online flag plus a break within ``near`` periods.

    Breaks are spread to the positions they cover, so the join is an equi join
    and a series' rows are never paired with all its breaks.
    """
    cover = breaks.select(*keys, F.explode(F.sequence(F.col("break_pos") - near, F.col("break_pos") + near)).alias("pos"))
    cover = cover.distinct().withColumn("break_near", F.lit(True))
    out = flagged.join(cover, [*keys, "pos"], "left")
    near_col = F.coalesce(F.col("break_near"), F.lit(False))
    return out.withColumns(
        {"break_near": near_col, "confirmations": F.col(flag).cast("int") + near_col.cast("int")}
    )


# ---- hysteresis --------------------------------------------------------------


@dataclass(frozen=True)
class HysteresisConfig:
    on_threshold: float = 2.0
    off_threshold: float = 1.0
    k_on: int = 2
    k_off: int = 2
    break_persistence: int = 3
    min_confirmations: int = 2

    def __post_init__(self) -> None:
        broken = [text for text, holds in _CONFIG_RULES if not holds(self)]
        if broken:
            raise ValueError("; ".join(broken))


#: What a configuration must satisfy, all checked at once.
_CONFIG_RULES = (
    ("thresholds must be finite and non-negative", lambda c: min(c.on_threshold, c.off_threshold) >= 0 and math.isfinite(c.on_threshold + c.off_threshold)),
    ("off_threshold must be below on_threshold", lambda c: c.off_threshold < c.on_threshold),
    ("persistence and confirmation settings must be >= 1", lambda c: all(n >= 1 for n in (c.k_on, c.k_off, c.break_persistence, c.min_confirmations))),
    ("break_persistence must be >= k_on", lambda c: c.k_on <= c.break_persistence),
)


def split_state_input(df: DataFrame, *, score: str = "score", confirmations: str = "confirmations") -> Split:
    """Scores must be finite and non-negative, confirmations non-negative whole numbers."""
    s, c = F.col(score).cast("double"), F.col(confirmations).cast("double")
    bad_score = s.isNull() | F.isnan(s) | (s < 0) | (s == math.inf)
    bad_conf = c.isNull() | F.isnan(c) | (c < 0) | (c == math.inf) | (c != F.floor(c))
    marked = df.withColumn(
        "reason_code", first_reason([("INVALID_SCORE", bad_score), ("INVALID_CONFIRMATIONS", bad_conf)])
    )
    return Split(
        marked.where(F.col("reason_code").isNull()).drop("reason_code"), marked.where(F.col("reason_code").isNotNull())
    )


def hysteresis(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: str | Sequence[str],
    score: str = "score",
    confirmations: str = "confirmations",
    config: HysteresisConfig = HysteresisConfig(),
    block: str | None = None,
) -> DataFrame:
    """State, streaks and reason of every row, for all series at once. Input must be clean.

    A streak is the distance of a running counter to its value at the last
    resetting row. The state is the highest level reached since the last
    release; levels of earlier episodes cannot win because the running maximum
    is taken over ``episode * 4 + level`` and episodes only grow.
    """
    along = {"keys": keys, "order": order, "block": block}
    s = F.col(score)
    df = df.withColumns({"_above": s >= config.on_threshold, "_below": s < config.off_threshold})
    df = _streaks(df, **along)
    released = F.col("_below") & (F.col("below_streak") >= config.k_off)
    confirmed = (
        F.col("_above")
        & (F.col("above_streak") >= config.break_persistence)
        & (F.col(confirmations) >= config.min_confirmations)
    )
    level = (
        F.when(confirmed, 3)
        .when(F.col("_above") & (F.col("above_streak") >= config.k_on), 2)
        .when(F.col("_above"), 1)
        .otherwise(0)
    )
    df = df.withColumns({"_released": released, "_confirmed": confirmed, "_level": level})
    df = _highest_of_episode(df, **along)
    df = df.withColumn("_state", F.pmod("_top", F.lit(4)))
    code = (
        F.when(F.col("_confirmed"), "CONFIRMED")
        .when(F.col("_above") & (F.col("_state") == 2), "SUSTAINED")
        .when(F.col("_above"), "CANDIDATE")
        .when(F.col("_released"), "RELEASED")
        .when(F.col("_below"), "RELEASE_PENDING")
        .when(F.col("_state") == 0, "BAND_NORMAL")
        .when(F.col("_state") == 1, "BAND_OBSERVE")
        .otherwise("BAND_ACTIVE")
    )
    texts = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    names = F.array(*[F.lit(x) for x in STATES])
    out = df.withColumns(
        {"state": F.element_at(names, F.col("_state").cast("int") + 1), "reason_code": code}
    ).withColumn("reason", F.element_at(texts, F.col("reason_code")))
    return out.drop(
        "_above", "_below", "_released", "_confirmed", "_level", "_top", "_state"
    )


def _streaks(df: DataFrame, *, keys: Sequence[str], order: str | Sequence[str], block: str | None) -> DataFrame:
    """``above_streak`` and ``below_streak``: running counts less their value at the last row that resets them.

    For a long series the blocks' counts and reset values are summed up in a
    first reading; the second one adds the carried ones and writes nothing.
    """
    here = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0) if block is None else inside(keys, block, order)
    counted = df.withColumns({"_n": F.row_number().over(here).cast("long"), "_na": F.sum(F.col("_above").cast("long")).over(here)})
    at = {"_na_at": F.when(F.col("_below"), F.col("_na")), "_n_at": F.when(~F.col("_below"), F.col("_n"))}
    zero = F.lit(0).cast("long")
    if block is not None:
        totals = counted.groupBy(*keys, block).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("_above").cast("long")).alias("na"), *[F.max(c).alias(name[1:]) for name, c in at.items()]
        )
        states = carried(totals, {"n": "sum", "na": "sum"}, keys=keys, block=block)
        states = states.withColumns({"na_at": F.col("na_at") + F.coalesce("_c_na", zero), "n_at": F.col("n_at") + F.coalesce("_c_n", zero)})
        states = carried(states, {"na_at": "max", "n_at": "max"}, keys=keys, block=block)
        counted = met(counted, states.select(*keys, block, "_c_n", "_c_na", "_c_n_at", "_c_na_at"), [*keys, block])
        counted = counted.withColumns({"_n": F.col("_n") + F.coalesce("_c_n", zero), "_na": F.col("_na") + F.coalesce("_c_na", zero)})
    else:
        counted = counted.withColumns({"_c_n_at": zero, "_c_na_at": zero})
    counted = counted.withColumns({name: F.max(c).over(here) for name, c in at.items()})
    out = counted.withColumns(
        {
            "above_streak": F.col("_na") - F.coalesce("_na_at", "_c_na_at", zero),
            "below_streak": F.col("_n") - F.coalesce("_n_at", "_c_n_at", zero),
        }
    )
    return out.drop("_n", "_na", "_na_at", "_n_at", "_c_n", "_c_na", "_c_n_at", "_c_na_at")


def _highest_of_episode(df: DataFrame, *, keys: Sequence[str], order: str | Sequence[str], block: str | None) -> DataFrame:
    """``_top``: four times the number of releases so far plus the highest level since the last one."""
    here = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0) if block is None else inside(keys, block, order)
    df = df.withColumn("_episode", F.sum(F.col("_released").cast("long")).over(here))
    df = df.withColumn("_top", F.max(F.col("_episode") * 4 + F.col("_level")).over(here))
    if block is not None:
        df = materialize(df, "episode_states")
        totals = df.groupBy(*keys, block).agg(F.max("_episode").alias("e"), F.max("_top").alias("t"))
        zero = F.lit(0).cast("long")
        states = carried(totals, {"e": "sum"}, keys=keys, block=block)
        states = carried(states.withColumn("t", F.col("t") + 4 * F.coalesce("_c_e", zero)), {"t": "max"}, keys=keys, block=block)
        df = met(df, states.select(*keys, block, "_c_e", "_c_t"), [*keys, block])
        df = df.withColumn("_top", F.greatest(F.col("_top") + 4 * F.coalesce("_c_e", zero), F.coalesce("_c_t", zero))).drop("_c_e", "_c_t")
    return df.drop("_episode")


# ---- evaluation --------------------------------------------------------------


def event_class(duration: Column | str) -> Column:
    d = F.col(duration) if isinstance(duration, str) else duration
    return F.when(d <= 3, "TRANSIENT_SHOCK").otherwise("REGIME_SHIFT")


def match_alarms(alarms: DataFrame, events: DataFrame, *, keys: Sequence[str], slack: int = 2) -> DataFrame:
    """Each event with the first alarm of its series and detector.

    ``alarms``: keys, detector, first_alarm. ``events``: keys, start, duration.
    An alarm in ``[start, start + duration + slack]`` detects; one before the
    start is early and false.
    """
    a, s = F.col("first_alarm"), F.col("start")
    hit = a.between(s, s + F.col("duration") + slack)
    return events.join(alarms, list(keys), "left").withColumns(
        {
            "detected": F.coalesce(hit, F.lit(False)),
            "false_early": F.coalesce(a < s, F.lit(False)),
            "delay": F.when(hit, a - s),
            "event_type": event_class("duration"),
            "localization_error": F.lit(None).cast("int"),
        }
    )


def match_breaks(breaks: DataFrame, events: DataFrame, *, keys: Sequence[str], hit_within: int = 2) -> DataFrame:
    """Each event with the distance to the nearest break of its series.

    Events and breaks stand in one line per series; the nearest break on either
    side is the last one seen from there, so no event is paired with all breaks.
    """
    rest = [c for c in events.columns if c not in (*keys, "start")]
    marks = events.select(*keys, F.col("start").alias("_at"), F.lit(None).cast("int").alias("_break"), F.lit(True).alias("_event"), *rest)
    points = breaks.select(*keys, F.col("break_pos").alias("_at"), F.col("break_pos").alias("_break")).distinct()
    line = marks.unionByName(points, allowMissingColumns=True)
    series = Window.partitionBy(*keys)
    # breaks come first among equal positions, in both directions
    seen = lambda order: F.last("_break", ignorenulls=True).over(series.orderBy(order, F.col("_event").asc_nulls_first()))
    line = line.withColumns({"_left": seen(F.col("_at").asc()), "_right": seen(F.col("_at").desc())})
    near = F.least(F.col("_at") - F.col("_left"), F.col("_right") - F.col("_at"))
    out = line.where("_event").select(*[F.col("_at").alias("start") if c == "start" else F.col(c) for c in events.columns], near.alias("localization_error"))
    return out.withColumns(
        {
            "detected": F.coalesce(F.col("localization_error") <= hit_within, F.lit(False)),
            "event_type": event_class("duration"),
        }
    )


def detection_summary(matched: DataFrame) -> DataFrame:
    """Rates, median delay and median localisation error per detector and event type (a few small integers).

    Delays belong to the online detectors, localisation errors to the offline one.
    """
    return matched.groupBy("detector", "event_type").agg(
        F.avg(F.col("detected").cast("double")).alias("detection_rate"),
        F.avg(F.col("false_early").cast("double")).alias("false_early_rate"),
        F.median("delay").alias("median_delay"),
        F.median("localization_error").alias("median_localization_error"),
        F.count(F.lit(1)).alias("events"),
    )


def scenario_summary(results: DataFrame) -> DataFrame:
    """Mean rates and median delays over scenario rows, per detector and event type."""
    return results.groupBy("detector", "event_type").agg(
        F.avg("detection_rate").alias("mean_detection_rate"),
        F.avg("false_early_rate").alias("mean_false_early_rate"),
        F.median("median_delay_periods").alias("median_delay"),
        F.median("median_localization_error").alias("median_localization_error"),
    )


def with_calibration(summary: DataFrame, calibration: DataFrame) -> DataFrame:
    """Summary rows with the null rate of their detector (one row per detector)."""
    return summary.join(calibration.select("detector", "null_path_fpr"), "detector", "left")


def best_online_detector(summary: DataFrame, *, rate: str = "detection_rate") -> DataFrame:
    """Highest rate for regime shifts; equal rates go by name."""
    online = summary.where((F.col("event_type") == "REGIME_SHIFT") & F.col("detector").isin("CUSUM", "PAGE_HINKLEY"))
    best = online.agg(F.min(F.struct((-F.col(rate)).alias("r"), F.col("detector"))).alias("b"), F.max(rate).alias(rate))
    return best.select(F.col("b.detector").alias("detector"), rate)


def peak_statistic(df: DataFrame, *, keys: Sequence[str], sides: Sequence[str]) -> DataFrame:
    """Largest detector statistic of each series: it alarms at ``h`` exactly when the peak exceeds ``h``."""
    live = F.greatest(*[F.abs(F.col(c)) for c in sides])
    return df.groupBy(*keys).agg(F.max(live).alias("peak"))


def choose_threshold(
    peaks: DataFrame, *, candidates: Sequence[float], target_rate: float = 0.10, by: Sequence[str] = ()
) -> DataFrame:
    """Smallest candidate whose share of alarming null series is at most the target, otherwise the last.

    All rates come from one pass with a counter per candidate.
    """
    cands = [float(c) for c in candidates]
    counted = peaks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("peak") > c).alias(f"a{i}") for i, c in enumerate(cands)]
    )
    return _smallest_meeting(counted, cands, target_rate, by)


def choose_penalty(
    series: DataFrame, breaks: DataFrame, *, keys: Sequence[str], candidates: Sequence[float], target_rate: float = 0.10
) -> DataFrame:
    """The same choice for the offline search: the share of null series in which a penalty finds any break.

    ``breaks``: keys and penalty, for all candidates.
    """
    cands = [float(c) for c in candidates]
    found = breaks.groupBy(*keys).agg(F.collect_set("penalty").alias("_found"))  # at most one entry per candidate
    flagged = series.select(*keys).distinct().join(found, list(keys), "left")
    counted = flagged.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.coalesce(F.array_contains("_found", c), F.lit(False))).alias(f"a{i}") for i, c in enumerate(cands)],
    )
    return _smallest_meeting(counted, cands, target_rate, ())


def _smallest_meeting(counted: DataFrame, cands: Sequence[float], target_rate: float, by: Sequence[str]) -> DataFrame:
    rates = [safe_ratio(F.col(f"a{i}"), F.col("n")) for i in range(len(cands))]
    met = F.coalesce(*[F.when(r <= target_rate, F.lit(i)) for i, r in enumerate(rates)])
    chosen = F.coalesce(met, F.lit(len(cands) - 1))
    return counted.select(
        *by,
        F.element_at(F.array(*[F.lit(c) for c in cands]), chosen + 1).alias("parameter"),
        F.element_at(F.array(*rates), chosen + 1).alias("null_path_fpr"),
        met.isNotNull().alias("target_met"),
    )


def probability_state(
    df: DataFrame, *, keys: Sequence[str], label: str, probability: str, min_margin: float = 0.10
) -> DataFrame:
    """Most probable label; UNCERTAIN when the lead over the second is below the margin.

    The two highest are found by an aggregate on small arrays, so a key with many
    candidate rows is reduced before the shuffle.
    """
    p = F.col(probability)
    top = df.groupBy(*keys).agg(
        F.max(p).alias("top"), F.max_by(label, p).alias("best"), F.count(p).alias("n")
    )
    second = (
        df.groupBy(*keys, probability)
        .agg(F.count(F.lit(1)).alias("m"))
        .join(top.select(*keys, "top"), list(keys))
        .groupBy(*keys)
        .agg(
            F.max(F.when(p < F.col("top"), p)).alias("below"),
            F.max(F.when(p == F.col("top"), F.col("m"))).alias("at_top"),
        )
    )
    joined = top.join(second.select(*keys, "below", "at_top"), list(keys), "left")
    runner = F.when(F.col("at_top") > 1, F.col("top")).otherwise(F.col("below"))
    uncertain = (F.col("n") == 0) | ((F.col("n") > 1) & (F.col("top") - runner < min_margin))
    return joined.select(
        *keys,
        F.when(F.coalesce(uncertain, F.lit(True)), F.lit("UNCERTAIN")).otherwise(F.col("best")).alias("state"),
        (F.col("top") - runner).alias("margin"),
    )
