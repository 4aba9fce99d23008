from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesora.operators import fiscal as fs
from tesora.operators import reconcile as rc
from tesora.operators import temporal as tm


def test_asof_violations(spark):
    df = spark.createDataFrame([("a", "2024-07-10"), ("b", "2024-06-20"), ("c", None)], "k string, publication_date string")
    assert [r["k"] for r in tm.asof_violations(df, "2024-07-01").collect()] == ["a"]
    with pytest.raises(Exception, match="published after"):
        tm.assert_asof(df, "2024-07-01").collect()
    assert tm.assert_asof(df, "2024-08-01").count() == 3


def test_ytd_to_flow(spark):
    rows = [("2024-01-31", "c1", 100.0), ("2024-02-29", "c1", 130.0), ("2024-03-31", "c2", 170.0), ("2025-01-31", "c2", 5.0)]
    df = spark.createDataFrame(rows, "period_end string, classification_version string, value double").withColumns(
        {"period_end": F.col("period_end").cast("date"), **{c: F.lit("x") for c in ("municipality_id", "indicator", "method_version", "scope")}, "unit": F.lit(None).cast("string")}
    )
    got = [(r["flow_derived"], r["flow_derivation_status"]) for r in tm.ytd_to_flow(df).orderBy("period_end").collect()]
    assert got == [(None, "no_prior_snapshot"), (30.0, "derived"), (None, "incompatible_snapshot"), (None, "no_prior_snapshot")]


def aggregates(spark, rows):
    df = spark.createDataFrame(rows, "oktmo string, period string, value double, available_at string")
    return df.select(
        "oktmo",
        F.col("period").cast("timestamp_ntz").alias("period"),
        F.lit("all").alias("category"),
        F.lit("income").alias("indicator"),
        "value",
        F.lit("rub").alias("unit"),
        F.lit("other_public").alias("source"),
        F.col("available_at").cast("timestamp_ntz").alias("available_at"),
        F.lit(False).alias("is_estimated"),
    )


def test_aggregate_contract(spark):
    rows = [
        ("71876000", "2025-12-31", 120.5, "2026-06-09"),
        ("71874000", "2025-12-31", 1.0, "2025-06-09"),
        ("7187", "2025-12-31", 1.0, "2026-06-09"),
        ("71875000", "2025-12-31", -1.0, "2026-06-09"),
        ("71871000", "2025-12-31", 1.0, "2026-06-09"),
        ("71871000", "2025-12-31", 2.0, "2026-06-09"),
    ]
    parts = tm.check_aggregates(aggregates(spark, rows))
    assert [r["oktmo"] for r in parts.clean.collect()] == ["71876000"]
    got = sorted(r["reason_code"] for r in parts.quarantine.collect())
    assert got == ["BAD_CODE", "BAD_VALUE", "DUPLICATE_KEY", "DUPLICATE_KEY", "RELEASE_BEFORE_PERIOD"]
    with pytest.raises(ValueError, match="extra"):
        tm.check_aggregates(aggregates(spark, rows).withColumn("extra", F.lit(1)))


def test_features_appear_on_release(spark):
    df = aggregates(spark, [("71876000", "2025-12-31", 120.5, "2026-06-09")])
    assert tm.features_as_of(df, "2026-06-08").clean.count() == 0
    assert tm.features_as_of(df, "2026-06-09").clean.first()["value"] == 120.5
    two = df.unionByName(aggregates(spark, [("71876000", "2024-12-31", 100.0, "2025-06-09")]))
    parts = tm.features_as_of(two, "2026-07-01")
    assert parts.clean.count() == 0 and parts.quarantine.first()["n_rows"] == 2
    assert tm.features_as_of(two, "2026-07-01", mode="latest").clean.first()["value"] == 120.5


def test_external_series(spark):
    row = ("2024-01-01", " Сургут ", "city", "cpi", "1,5", "u", "s", "2024-02-01", "2024-02-02")
    cols = ", ".join(f"{c} string" for c in tm.EXTERNAL_COLUMNS)
    df = spark.createDataFrame([row, ("bad", *row[1:])], cols)
    parts = tm.normalize_external(df)
    assert parts.quarantine.first()["reason_code"] == "BAD_PERIOD"
    got = tm.extract_series(parts.clean, geography="Сургут", variable="cpi").first()
    assert got["value"] == 1.5
    cov = tm.coverage(parts.clean).first()
    assert (cov["rows"], cov["geographies"], cov["start_period"]) == (1, 1, "2024-01-01")


# ---- two sources -------------------------------------------------------------


def side(spark, values, available="2020-01-01", measure="cash"):
    rows = [(str(2000 + i), "001", float(v), available, "annual", "rub", measure) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "period string, oktmo string, value double, available_at string, frequency string, unit string, measure string")


def status(spark, a, b):
    row = rc.reconcile(a, b, as_of="2026-01-01").first()
    return None if row is None else (row["n"], row["status"], row["correlation"])


def test_reconcile(spark):
    assert status(spark, side(spark, [1, 2]), side(spark, [2, 4])) == (2, "insufficient", None)
    n, state, corr = status(spark, side(spark, range(8)), side(spark, range(8)))
    assert (n, state) == (8, "consistent") and corr == pytest.approx(1.0)
    assert status(spark, side(spark, range(8)), side(spark, [1] * 8))[1] == "insufficient"
    assert status(spark, side(spark, range(8)), side(spark, range(8), "2027-01-01")) is None
    assert status(spark, side(spark, range(8)), side(spark, [-v for v in range(8)]))[1] == "inconsistent"
    twice = side(spark, range(8)).unionByName(side(spark, range(8)))
    assert status(spark, twice, side(spark, range(8)))[1] == "duplicate_period"
    assert status(spark, side(spark, range(8)), side(spark, range(8), measure="accrual"))[1] == "not_comparable"
    with pytest.raises(ValueError):
        rc.reconcile(twice, twice, as_of="2026-01-01", min_periods=2)


def test_table_diff(spark):
    schema = "k int, v double, t string, seq int"
    before = spark.createDataFrame([(1, 1.0, "a", 1), (2, 2.0, "b", 1), (3, 0.1 + 0.2, " c", 1), (5, None, "e", 1)], schema)
    after = spark.createDataFrame([(1, 9.0, "a", 1), (1, 1.0, "a ", 2), (2, 2.5, "b", 1), (3, 0.3, "c", 1), (4, 4.0, "d", 1), (5, None, "e", 1)], schema)
    got = {r["k"]: r["change"] for r in rc.table_diff(before, after, keys=["k"], seq="seq").collect()}
    assert got == {1: "SAME", 2: "CHANGED", 3: "SAME", 4: "ADDED", 5: "SAME"}
    gone = rc.diff_summary(rc.table_diff(after, before, keys=["k"], seq="seq")).first()
    assert (gone["added_keys"], gone["removed_keys"], gone["changed_keys"], gone["same_keys"]) == (0, 1, 1, 3)


def test_row_count_gate(spark):
    before = spark.createDataFrame([("a", 100), ("b", 100), ("c", 10), ("d", 0)], "table_name string, rows int")
    after = spark.createDataFrame([("a", 80), ("b", 79)], "table_name string, rows int")
    got = {r["table_name"]: r["rejected"] for r in rc.row_count_gate(before, after).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False}


# ---- fiscal panel ------------------------------------------------------------


def core(spark, rows):
    return spark.createDataFrame(rows, "year int, municipality_name string, " + ", ".join(f"{c} string" for c in fs.CORE_AMOUNTS) + ", ingest_seq int")


def test_fiscal_panel(spark):
    good = (2025, "Сургут ", "19 230 756,2", "1258440.4", "21628115.2", "1126274.6", "45970377.8", "49453472.8", "4.0", "0.0", "18763424.4")
    rows = [(*good, 2), (2025, "Сургут", *["1"] * 9, 1), (2025, "123", *["1"] * 9, 1), (2025, "", *["1"] * 9, 1), (2024, "Б", *["#N/A"] * 9, 1)]
    rank = spark.createDataFrame([(2025, "Сургут", "7,0", "f.xls", 1)], "year int, municipality_name string, rank string, source_file string, ingest_seq int")
    got = {r["municipality_name"]: r for r in fs.fiscal_panel(core(spark, rows), rank).collect()}
    assert set(got) == {"Сургут", "Б"}
    assert round(got["Сургут"]["income_plan_deviation"], 6) == 0.110555 and round(got["Сургут"]["program_expense_share"], 6) == 0.929568
    assert got["Сургут"]["budget_amendments"] == 4.0 and got["Сургут"]["quality_rank"] == 7.0
    assert got["Сургут"]["period_end"] == dt.date(2025, 12, 31)
    assert got["Б"]["debt_load"] is None and got["Б"]["source_file"] == ""


def test_screening(spark):
    rows = [(2025, f"m{i}", -0.05 if i == 0 else 0.1, i / 10, float(i), float(10 - i) if i else None) for i in range(10)]
    df = spark.createDataFrame(rows, "year int, municipality_name string, income_plan_deviation double, debt_load double, budget_amendments double, quality_rank double")
    flags = fs.screening_flags(df, pieces=3)
    on = {(r["municipality_name"], r["code"]) for r in flags.where("active").collect()}
    assert ("m0", "income_shortfall") in on and ("m0", "debt_peer_high") not in on
    assert {m for m, c in on if c == "debt_peer_high"} == {"m7", "m8", "m9"}
    assert {m for m, c in on if c == "quality_rank_peer"} == {"m1", "m2", "m3"}
    text = {r["municipality_name"]: r for r in fs.screening_conclusion(flags).collect()}
    assert text["m5"]["active_flags"] == 0 and text["m5"]["conclusion"] == fs.NO_FLAGS_TEXT
    assert text["m9"]["active_flags"] == 2
    got = {(r["municipality_name"], r["domain"]): (r["status"], r["evidence"]) for r in fs.domain_assessments(flags).collect()}
    assert got["m9", "Municipal Finance"] == ("SCREENING_SIGNAL", "MEDIUM")
    assert got["m0", "Municipal Finance"] == ("SCREENING_SIGNAL", "LOW")
    assert got["m5", "Municipal Finance"] == ("CONTEXT", "LOW")
    assert got["m5", "Consumer Demand"] == ("NO_DATA", "INSUFFICIENT")


def test_latest(spark):
    df = spark.createDataFrame([("a", 2023, 1.0), ("a", 2024, None), ("b", 2022, 5.0)], "m string, year int, v double")
    assert {(r["m"], r["year"]) for r in fs.latest_row(df, entity=["m"], order="year").collect()} == {("a", 2024), ("b", 2022)}
    got = {r["m"]: r["v"] for r in fs.latest_values(df, entity=["m"], order="year", columns=["v"]).collect()}
    assert got == {"a": 1.0, "b": 5.0}
