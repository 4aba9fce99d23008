from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesora.operators import budget as bg
from tesora.operators.contracts import enforce, split

LINES = [
    # side, group, item, amount, transfer, recurring, subvention, service, borrowing, flexibility
    ("REVENUE", "Own", "Tax", 100.0, "0", "1", "0", "0", "0", "UNKNOWN"),
    ("REVENUE", "Grants", "Grant", 20.0, "да", "1", "0", "0", "0", None),
    ("EXPENDITURE", "Social", "Schools", 85.0, "0", "true", "0", "0", "0", "fixed"),
    ("EXPENDITURE", "Roads", "Repairs", 45.0, "0", "0", "0", "0", "0", "FLEXIBLE"),
    ("EXPENDITURE", "Debt", "Interest", 5.0, "0", "0", "0", "yes", "0", "FIXED"),
    ("FINANCING", "Loans", "Loan", 10.0, "0", "0", "0", "0", "y", "UNKNOWN"),
    ("EXCEPTION", "Special", "Balance", 2.0, "0", "0", "0", "0", "0", "UNKNOWN"),
]


def lines(spark, rows=LINES):
    cols = "budget_side string, `group` string, item_name string, amount double, is_transfer string, is_recurring string, "
    cols += "is_subvention string, is_debt_service string, is_borrowing string, flexibility string"
    df = spark.createDataFrame(rows, cols)
    return df.withColumns({"year": F.lit("2025"), "municipality_name": F.lit(" Town ")})


def inputs(spark, **values):
    base = {"revenue_base": 100.0, "transfers": 20.0, "expenditure": 135.0}
    values = {**base, **values}
    df = spark.range(1).select(
        F.lit("Town").alias("municipality_name"), F.lit(2025).alias("year"), *[F.lit(v).alias(k) for k, v in values.items()]
    )
    return bg.with_defaults(df)


def result(spark, **values):
    return bg.budget_result(inputs(spark, **values)).first()


def test_summary(spark):
    clean = bg.normalize_lines(lines(spark)).clean
    row = bg.summarize(clean).first()
    assert row["municipality_name"] == "Town" and row["rows"] == 7
    got = {k: row[k] for k in ("revenue_base", "transfers", "expenditure", "recurring_revenue", "recurring_expenditure")}
    assert got == {"revenue_base": 100, "transfers": 20, "expenditure": 135, "recurring_revenue": 120, "recurring_expenditure": 85}
    assert (row["financing_sources"], row["planned_net_borrowing"], row["debt_service"], row["eligible_exceptions"]) == (10, 10, 5, 2)


def test_bad_lines_go_aside(spark):
    bad = [("INCOME", "g", "i", 1.0), ("REVENUE", "g", "i", -1.0), ("REVENUE", "g", "i", None)]
    rows = [(*b, "0", "0", "0", "0", "0", "UNKNOWN") for b in bad] + [("REVENUE", "g", "i", 1.0, "0", "0", "0", "0", "0", "SOFT")]
    parts = bg.normalize_lines(lines(spark, rows))
    assert parts.clean.count() == 0
    assert sorted(r["reason_code"] for r in parts.quarantine.collect()) == [
        "BAD_AMOUNT",
        "NEGATIVE_AMOUNT",
        "UNKNOWN_FLEXIBILITY",
        "UNKNOWN_SIDE",
    ]
    with pytest.raises(ValueError, match="missing columns"):
        bg.normalize_lines(lines(spark).drop("amount"))


def test_structure_exposure_and_cut(spark):
    clean = bg.normalize_lines(lines(spark)).clean
    shares = bg.group_structure(clean, "expenditure").collect()
    assert sum(r["share"] for r in shares) == pytest.approx(1.0)
    gap = lambda g: spark.createDataFrame([("Town", 2025, g)], "municipality_name string, year int, normalization_gap double")
    assert sum(r["gap_exposure"] for r in bg.gap_exposure(clean, gap(13.0)).collect()) == pytest.approx(13.0)
    cut = {r["group"]: (r["mechanical_cut"], r["remaining_gap"]) for r in bg.flexible_cut(clean, gap(30.0)).collect()}
    assert cut == {"Roads": (30.0, 0.0), "Social": (0.0, 0.0), "Debt": (0.0, 0.0)}
    assert bg.flexible_cut(clean, gap(60.0)).first()["remaining_gap"] == 15.0
    top = bg.top_groups(clean, n=1).first()
    assert (top["group"], top["rank"]) == ("Social", 1)


def test_result_and_gaps(spark):
    row = result(spark, eligible_exceptions=2.0, recurring_revenue=100.0, recurring_expenditure=110.0, current_debt=30.0,
                 planned_net_borrowing=-40.0, debt_service=6.0, financing_sources=4.0)
    assert (row["total_revenue"], row["balance"], row["deficit"]) == (120, -15, 15)
    assert row["deficit_ratio"] == 0.15 and row["base_deficit_limit"] == 10 and row["allowed_deficit"] == 12
    assert (row["raw_normalization_gap"], row["normalization_gap"], row["structural_gap"], row["financing_gap"]) == (5, 3, 10, 11)
    assert row["debt_after"] == 0 and row["debt_headroom"] == 100
    assert row["debt_service_ratio"] == pytest.approx(6 / 135)
    assert not row["deficit_within_configured_limit"] and row["debt_within_configured_limit"]


def test_separate_base_and_zero_base(spark):
    assert result(spark, deficit_base=50.0)["deficit_ratio"] == 0.3
    assert result(spark, revenue_base=0.0, transfers=0.0)["deficit_ratio"] == 0.0
    assert result(spark, debt_service=5.0, expenditure_ex_subventions=50.0)["debt_service_ratio"] == 0.1


@pytest.mark.parametrize(
    ("field", "value", "reason"),
    [
        ("expenditure", -1.0, "NEGATIVE_AMOUNT"),
        ("deficit_limit_ratio", 1.1, "DEFICIT_LIMIT_RANGE"),
        ("debt_limit_ratio", 2.1, "DEBT_LIMIT_RANGE"),
        ("debt_service_limit_ratio", -0.1, "SERVICE_LIMIT_RANGE"),
        ("deficit_base", -1.0, "NEGATIVE_DEFICIT_BASE"),
    ],
)
def test_input_rules(spark, field, value, reason):
    df = inputs(spark, **{field: value})
    assert split(df, bg.input_rules()).quarantine.first()["reason_code"] == reason
    with pytest.raises(Exception, match=reason):
        enforce(df, bg.input_rules()).collect()


def test_closing_scenarios_close_the_gap(spark):
    base = bg.budget_result(inputs(spark))
    rows = {r["scenario"]: r for r in bg.closing_scenarios(base).collect()}
    assert set(rows) == set(bg.CLOSURE_NAMES)
    for r in rows.values():
        assert r["gap_to_close"] == 5 and r["normalization_gap"] == pytest.approx(0.0, abs=1e-9)
    balanced = bg.budget_result(inputs(spark, expenditure=110.0))
    assert all(r["revenue_base_change"] == 0 for r in bg.closing_scenarios(balanced).collect())


def test_scenarios(spark):
    out = bg.scenario(inputs(spark), [{"scenario": "cut", "expenditure_change": -500.0, "net_borrowing_change": -3.0}]).first()
    assert out["expenditure"] == 0 and out["planned_net_borrowing"] == -3 and out["scenario"] == "cut"
    table = spark.createDataFrame([("Town", "grow", 50.0)], "municipality_name string, scenario string, revenue_base_change double")
    assert bg.scenario(inputs(spark), table).first()["revenue_base"] == 150
    with pytest.raises(ValueError):
        bg.scenario(inputs(spark), table.drop("municipality_name"))


def test_gap_structure_criteria_components(spark):
    df = bg.budget_result(inputs(spark, recurring_revenue=100.0, recurring_expenditure=103.0, eligible_exceptions=1.0))
    row = bg.gap_structure(df).first()
    assert (row["normalization_gap"], row["structural_overlap"], row["non_structural_remainder"]) == (4, 3, 1)
    assert row["revenue_base_to_close"] == pytest.approx(4 / 1.1)
    got = {r["code"]: r for r in bg.criteria(df).collect()}
    assert {c: got[c]["status"] for c in got} == {
        "deficit": "BREACH",
        "structural": "WATCH",
        "financing": "WATCH",
        "debt": "OK",
        "debt_service": "OK",
    }
    assert got["deficit"]["limit"] == pytest.approx(0.11) and got["financing"]["headroom"] == -15
    assert bg.components(df).count() == 10


def test_adopted_plan_rows(spark):
    # the adopted plan of 2025-2027, thousands of roubles: base, transfers, expenditure, legal base, exceptions, financing
    plans = [
        (2025, 20489196.60116, 28789166.99403, 51520222.17054, 16835878.76983, 1285538.88023, 2241858.57535),
        (2026, 19901372.70499, 25261368.79081, 47247710.40792, 17520706.32538, 384916.048, 2084968.91212),
        (2027, 21773828.40757, 25191572.79081, 48036682.89113, 18430466.0723, 0.0, 1071281.69275),
    ]
    df = spark.createDataFrame(
        plans,
        "year int, revenue_base double, transfers double, expenditure double, deficit_base double, "
        "eligible_exceptions double, financing_sources double",
    )
    got = bg.budget_result(bg.with_defaults(df.withColumn("municipality_name", F.lit("t")))).orderBy("year").collect()
    assert [round(r["deficit_ratio"] * 100, 1) for r in got] == [13.3, 11.9, 5.8]
    assert [r["normalization_gap"] for r in got] == [0.0, 0.0, 0.0]


def test_plan_arithmetic(spark):
    df = spark.createDataFrame([(100.0, 130.0, 10.0), (100.0, 90.0, 0.0)], "total_revenue double, expenditure double, financing_sources double")
    got = [(r["calculated_deficit"], r["uncovered_plan_need"]) for r in bg.plan_arithmetic(df).collect()]
    assert got == [(30.0, 20.0), (-10.0, 0.0)]
