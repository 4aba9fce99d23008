"""Structured Streaming twins of the detectors and the state machine, and late revisions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tesora.operators import bocpd
from tesora.operators.detect import STATES, HysteresisConfig

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DETECTOR_OUTPUT = (
    "series_id string, t long, value double, pos long, z double, cusum_up double, cusum_down double, cusum_flag boolean, "
    "ph_up double, ph_down double, page_hinkley_flag boolean, late boolean"
)
HYSTERESIS_OUTPUT = (
    "series_id string, t long, score double, confirmations int, state string, above_streak long, below_streak long, late boolean"
)
RUN_LENGTH_OUTPUT = f"series_id string, t long, value double, {bocpd.OUTPUT}, late boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """State beyond memory needs the RocksDB store; stateful processors require it."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame], last_t: int | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows of one micro-batch by time, split into new ones and ones at or before the last folded time.

    The size of a micro-batch is set by the source (``maxFilesPerTrigger`` and the like).
    """
    batch = pd.concat(list(rows), ignore_index=True).sort_values("t", kind="stable")
    late = batch["t"].duplicated()
    if last_t is not None:
        late |= batch["t"] <= last_t
    return batch[~late], batch[late]


class OnlineDetectors(StatefulProcessor):
    """CUSUM and Page-Hinkley per series, one point at a time."""

    def __init__(self, cusum_threshold=5.0, drift=0.5, ph_threshold=8.0, delta=0.05, warmup=12):
        self.cusum_threshold, self.drift = cusum_threshold, drift
        self.ph_threshold, self.delta, self.warmup = ph_threshold, delta, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ("n long", "last_t long", "mean double", "m2 double", "all_mean double", "up double", "down double")
        fields += ("p double", "p_min double", "q double", "q_min double")
        self.state = handle.getValueState("detectors", ", ".join(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last_t, mean, m2, avg, up, down, p, p_min, q, q_min = (
            self.state.get() if self.state.exists() else (0, None, *([0.0] * 9))
        )
        fresh, late = _in_order(rows, last_t)
        out = []
        for t, x in zip(fresh["t"].tolist(), fresh["value"].tolist()):
            avg += (x - avg) / (n + 1)
            z = None
            if n < self.warmup:
                step = x - mean
                mean += step / (n + 1)
                m2 += step * (x - mean)
            else:
                sd = math.sqrt(m2 / self.warmup) or 1.0
                z = (x - mean) / sd
                up, down = max(0.0, up + z - self.drift), min(0.0, down + z + self.drift)
                p, q = p + x - avg - self.delta, q - x + avg - self.delta
                p_min, q_min = min(p_min, p), min(q_min, q)
            live = n >= self.warmup
            out.append(
                (
                    *key, t, x, n, z, up, down, live and (up > self.cusum_threshold or -down > self.cusum_threshold),
                    p - p_min, q - q_min, live and (p - p_min > self.ph_threshold or q - q_min > self.ph_threshold), False,
                )
            )
            n, last_t = n + 1, t
        out += [(*key, t, x, *([None] * 8), True) for t, x in zip(late["t"].tolist(), late["value"].tolist())]
        if len(fresh):
            self.state.update((n, int(last_t), mean, m2, avg, up, down, p, p_min, q, q_min))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in DETECTOR_OUTPUT.split(", ")]).astype(
            {"pos": "Int64", "cusum_flag": "boolean", "page_hinkley_flag": "boolean"}
        )

    def close(self) -> None:
        pass


class OnlineHysteresis(StatefulProcessor):
    """One contour's state per series, one score at a time."""

    def __init__(self, config: HysteresisConfig = HysteresisConfig()):
        self.settings = asdict(config)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("contour", "level int, above long, below long, last_t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c = HysteresisConfig(**self.settings)
        level, above, below, last_t = self.state.get() if self.state.exists() else (0, 0, 0, None)
        fresh, late = _in_order(rows, last_t)
        out = []
        for t, score, conf in zip(fresh["t"].tolist(), fresh["score"].tolist(), fresh["confirmations"].tolist()):
            if score >= c.on_threshold:
                above, below = above + 1, 0
                confirmed = above >= c.break_persistence and conf >= c.min_confirmations
                level = max(level, 3 if confirmed else 2 if above >= c.k_on else 1)
            elif score < c.off_threshold:
                above, below = 0, below + 1
                level = 0 if below >= c.k_off else level
            else:
                below = 0
            out.append((*key, t, score, conf, STATES[level], above, below, False))
            last_t = t
        out += [
            (*key, t, s, n, None, None, None, True)
            for t, s, n in zip(late["t"].tolist(), late["score"].tolist(), late["confirmations"].tolist())
        ]
        if len(fresh):
            self.state.update((level, above, below, int(last_t)))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in HYSTERESIS_OUTPUT.split(", ")]).astype(
            {"above_streak": "Int64", "below_streak": "Int64"}
        )

    def close(self) -> None:
        pass


class OnlineRunLengths(StatefulProcessor):
    """Run-length posterior per series, one point at a time; the state is the kept run lengths."""

    def __init__(self, model: bocpd.RunLengthModel = bocpd.RunLengthModel()):
        self.settings = asdict(model)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run_lengths", "seen long, last_t long, lost double, runs binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        model = bocpd.RunLengthModel(**self.settings)
        last_t, held = None, bocpd.RunLengths(model)
        if self.state.exists():
            seen, last_t, lost, runs = self.state.get()
            held = bocpd.RunLengths.load(model, seen, lost, bytes(runs))
        fresh, late = _in_order(rows, last_t)
        out = [(*key, t, x, *held.step(x), False) for t, x in zip(fresh["t"].tolist(), fresh["value"].tolist())]
        out += [(*key, t, x, *([None] * len(bocpd.NAMES)), True) for t, x in zip(late["t"].tolist(), late["value"].tolist())]
        if len(fresh):
            self.state.update((held.seen, int(fresh["t"].iloc[-1]), held.lost, held.dump()))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in RUN_LENGTH_OUTPUT.split(", ")]).astype(
            {"pos": "Int64", "run_length": "Int64", "kept": "Int32", "bocpd_flag": "boolean"}
        )

    def close(self) -> None:
        pass


def run_length_stream(points: DataFrame, model: bocpd.RunLengthModel = bocpd.RunLengthModel()) -> DataFrame:
    """``points``: series_id, t, value (finite). Equals :func:`tesora.operators.bocpd.run_lengths` row by row."""
    return points.groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=OnlineRunLengths(model),
        outputStructType=RUN_LENGTH_OUTPUT,
        outputMode="Append",
        timeMode="None",
    )


def detector_stream(points: DataFrame, **settings) -> DataFrame:
    """``points``: series_id, t, value. Rows at or before the last folded time come out as late."""
    return points.groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=OnlineDetectors(**settings),
        outputStructType=DETECTOR_OUTPUT,
        outputMode="Append",
        timeMode="None",
    )


def hysteresis_stream(scores: DataFrame, config: HysteresisConfig = HysteresisConfig()) -> DataFrame:
    """``scores``: series_id, t, score, confirmations; checked before (see ``split_state_input``)."""
    return scores.groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=OnlineHysteresis(config),
        outputStructType=HYSTERESIS_OUTPUT,
        outputMode="Append",
        timeMode="None",
    )


# ---- late revisions ----------------------------------------------------------


def _newest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(version)).alias("row"))
    return picked.select("row.*")


def revision_writer(path: str, keys: Sequence[str], version: str = "available_at"):
    """A ``foreachBatch`` sink: the newest version per key of each batch, in the batch's own folder.

    A repeated batch overwrites its folder, so retries change nothing; nothing
    already written is read back or rewritten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _newest(batch, keys, version).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def start_revisions(
    facts: DataFrame, *, path: str, checkpoint: str, keys: Sequence[str], version: str = "available_at"
):
    """Stream of facts to versioned folders, however late they are.

    Each batch keeps the newest version per key and readers pick the newest over
    all batches, so repeats are harmless and no state or watermark is needed.
    """
    return (
        facts.writeStream.foreachBatch(revision_writer(path, keys, version))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_revisions(spark: SparkSession, path: str, keys: Sequence[str], version: str = "available_at") -> DataFrame:
    """The newest version of every key over all batches."""
    return _newest(spark.read.parquet(path).drop("batch"), keys, version)


def run_to_parquet(stream: DataFrame, *, path: str, checkpoint: str) -> None:
    """Process everything available now into a Parquet folder and wait for the end."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
