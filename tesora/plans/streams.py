"""Streaming twins run over the shared tables until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesora.operators import detect as dt
from tesora.plans import inputs as data
from tesora.plans.detection import KEYS, ORDER, _cusum_sql, _hysteresis_sql, _ph_sql, _run_length_sql, _scored, _z_sql
from tesora.plans.registry import query, rounded, sql_round as r
from tesora.session import shared_folder
from tesora.streaming import online


def _series(df):
    return F.concat_ws("|", *[F.col(k) for k in KEYS]).alias("series_id"), F.unix_date("period_start").cast("long").alias("t")


def _landed(spark, df):
    """Rows landing in three steps of time, read back as a stream of several micro-batches.

    Each step keeps a series in one file, so files of one step may come in any order.
    """
    path = shared_folder(spark, "landing")
    year = F.year(F.date_from_unix_date(F.col("t").cast("int")))
    for part in (year < 1997, year.between(1997, 1998), year > 1998):
        df.where(part).repartition("series_id").write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def _run(spark, stream):
    folder = shared_folder(spark, "stream")
    online.run_to_parquet(stream, path=f"{folder}/out", checkpoint=f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_SERIES_SQL = "oktmo || '|' || category_code AS series_id, CAST(date_diff('day', DATE '1970-01-01', period_start) AS BIGINT) AS t"


@query(
    "online_detectors",
    f"""WITH {data.panel_sql('region')}, {_z_sql('region')}, {_cusum_sql(5.0)}, {_ph_sql(8.0)}
SELECT oktmo || '|' || category_code AS series_id, count(*) FILTER (cusum_flag) AS cusum_alarms, count(*) FILTER (page_hinkley_flag) AS page_hinkley_alarms,
  min(cusum.pos) FILTER (cusum_flag) AS first_cusum, count(*) AS points FROM cusum JOIN ph USING (oktmo, category_code, period_start) GROUP BY 1""",
)
def online_detectors(spark, sf):
    online.use_rocksdb(spark)
    # the batch twin of the second detector runs on standardised values, so both see the score here
    z = dt.baseline_standardize(data.panel(spark, sf, "region"), keys=KEYS, **ORDER)
    points = _landed(spark, z.select(*_series(z), F.col("z").alias("value")))
    flags = _run(spark, online.detector_stream(points))
    return flags.groupBy("series_id").agg(
        F.count_if("cusum_flag").alias("cusum_alarms"),
        F.count_if("page_hinkley_flag").alias("page_hinkley_alarms"),
        F.min(F.when(F.col("cusum_flag"), F.col("pos"))).alias("first_cusum"),
        F.count(F.lit(1)).alias("points"),
    )


@query(
    "online_run_lengths",
    f"""WITH RECURSIVE {_run_length_sql("region")}
SELECT {_SERIES_SQL}, CAST(run_length AS BIGINT) AS run_length, {r("p_recent", 5)} AS p_recent FROM run_lengths JOIN z USING (oktmo, category_code, pos)""",
)
def online_run_lengths(spark, sf):
    online.use_rocksdb(spark)
    z = dt.baseline_standardize(data.panel(spark, sf, "region"), keys=KEYS, **ORDER)
    points = _landed(spark, z.select(*_series(z), F.col("z").alias("value")))
    return rounded(_run(spark, online.run_length_stream(points)).select("series_id", "t", "run_length", "p_recent"), 5, "p_recent")


@query(
    "online_hysteresis",
    f"""WITH {data.panel_sql('region')}, {_z_sql('region')}, {_cusum_sql(5.0)}, {_hysteresis_sql('cusum')}
SELECT {_SERIES_SQL}, state, above_streak, below_streak FROM states""",
)
def online_hysteresis(spark, sf):
    online.use_rocksdb(spark)
    scored = _scored(dt.cusum(data.panel(spark, sf, "region"), keys=KEYS, **ORDER))
    rows = _landed(spark, scored.select(*_series(scored), "score", "confirmations"))
    return _run(spark, online.hysteresis_stream(rows)).select("series_id", "t", "state", "above_streak", "below_streak")


@query(
    "late_revisions",
    f"""SELECT user_id, event_type, CAST(ts AS DATE) AS day, max(ts) AS available_at, {r("arg_max(value, ts)", 2)} AS value FROM events GROUP BY 1, 2, 3""",
)
def late_revisions(spark, sf):
    keys = ["user_id", "event_type", "day"]
    facts = (
        spark.readStream.schema(data.SCHEMAS["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select("user_id", "event_type", F.col("ts").cast("date").alias("day"), F.col("ts").cast("timestamp").alias("available_at"), "value")
    )
    folder = shared_folder(spark, "revisions")
    online.start_revisions(facts, path=f"{folder}/facts", checkpoint=f"{folder}/checkpoint", keys=keys).awaitTermination()
    newest = online.read_revisions(spark, f"{folder}/facts", keys)
    return rounded(newest.withColumn("available_at", F.col("available_at").cast("timestamp_ntz")), 2, "value")
