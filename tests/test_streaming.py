from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesora.operators import detect as dt
from tesora.session import shared_folder
from tesora.streaming import online


def landed(spark, *frames):
    """Each frame becomes one file, in order."""
    path = shared_folder(spark, "test_landing")
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream):
    root = shared_folder(spark, "test_stream")
    online.run_to_parquet(stream, path=f"{root}/out", checkpoint=f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def test_detectors_equal_the_batch(spark):
    online.use_rocksdb(spark)
    rng = random.Random(4)
    data = [(f"s{k}", t, rng.gauss(0, 1) + (3 if t > 25 and k % 2 else 0)) for k in range(6) for t in range(40)]
    df = spark.createDataFrame(data, "series_id string, t long, value double")
    late = spark.createDataFrame([("s0", 3, 9.0)], df.schema)
    stream = online.detector_stream(landed(spark, df.where("t < 15"), df.where("t between 15 and 29"), df.where("t >= 30"), late))
    got = run(spark, stream)
    assert got.where("late").count() == 1
    live = {(r["series_id"], r["t"]): r for r in got.where("not late").collect()}
    by = dict(keys=["series_id"], order="t", value="value")
    a = {(r["series_id"], r["t"]): r for r in dt.cusum(df, **by).collect()}
    b = {(r["series_id"], r["t"]): r for r in dt.page_hinkley(df, **by).collect()}
    assert len(live) == 240
    for k, row in live.items():
        assert row["cusum_flag"] == a[k]["cusum_flag"] and row["page_hinkley_flag"] == b[k]["page_hinkley_flag"]
        if k[1] >= 12:
            assert row["cusum_up"] == pytest.approx(a[k]["cusum_up"], abs=1e-9)
            assert row["ph_down"] == pytest.approx(b[k]["ph_down"], abs=1e-9)


def test_hysteresis_equals_the_batch(spark):
    online.use_rocksdb(spark)
    rng = random.Random(9)
    data = [(f"s{k}", t, rng.choice([0.5, 1.5, 2.5]), rng.randint(0, 2)) for k in range(5) for t in range(30)]
    df = spark.createDataFrame(data, "series_id string, t long, score double, confirmations int")
    got = run(spark, online.hysteresis_stream(landed(spark, df.where("t < 11"), df.where("t >= 11"))))
    want = dt.hysteresis(df, keys=["series_id"], order="t")
    cols = ("series_id", "t", "state", "above_streak", "below_streak")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_revisions_keep_the_newest(spark):
    schema = "k string, available_at string, v int"
    first = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-01", 1), ("b", "2024-01-02", 5)], schema)
    # key c is first seen 61 days behind key a
    second = spark.createDataFrame([("a", "2024-03-10", 2), ("b", "2024-01-01", 4), ("c", "2024-01-09", 7)], schema)
    stamp = lambda df: df.withColumn("available_at", F.col("available_at").cast("timestamp"))
    root = shared_folder(spark, "test_revisions")
    facts = landed(spark, stamp(first), stamp(second))
    online.start_revisions(facts, path=f"{root}/facts", checkpoint=f"{root}/checkpoint", keys=["k"]).awaitTermination()
    got = {r["k"]: r["v"] for r in online.read_revisions(spark, f"{root}/facts", ["k"]).collect()}
    assert got == {"a": 2, "b": 5, "c": 7}
