from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesora.functions import scalar as S
from tesora.functions.unicode_names import nfkc_name_key


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 234,5", 1234.5),
        ("1 234,5", 1234.5),
        ("−12,5", -12.5),
        ("#N/A", None),
        ("", None),
        ("abc", None),
        ("1e3", 1000.0),
        ("NaN", None),
        ("1.0d", None),
        (None, None),
    ],
)
def test_numbers(spark, text, want):
    assert one(spark, S.parse_number(F.lit(text).cast("string"))) == want


def test_booleans(spark):
    df = spark.createDataFrame([("Да", 2.0, True), (" no ", 0.0, None), (None, None, False)], "a string, b double, c boolean")
    got = [tuple(r) for r in df.select(S.parse_bool(df, "a"), S.parse_bool(df, "b"), S.parse_bool(df, "c")).collect()]
    assert got == [(True, True, True), (False, False, False), (False, False, False)]


def test_indicators(spark):
    assert one(spark, S.i13(F.lit(90.0), F.lit(10.0), F.lit(60.0), F.lit(20.0))) == 0.0
    assert round(one(spark, S.i13(F.lit(90.0), F.lit(10.0), F.lit(90.0), F.lit(21.0))), 6) == 0.11
    # published amounts of 2025
    assert one(spark, S.i13(F.lit(19230756.2), F.lit(1258440.4), F.lit(21628115.2), F.lit(1126274.6))) == pytest.approx(0.110555, abs=5e-7)
    assert one(spark, S.i15(F.lit(45970377.8), F.lit(49453472.8))) == pytest.approx(0.929568, abs=5e-7)
    assert one(spark, S.i26(F.lit(5713.5), F.lit(49453472.8))) == pytest.approx(0.000115533, abs=5e-10)
    assert one(spark, S.i25(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0))) == 2.0
    assert one(spark, S.safe_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.coverage_gap(F.lit(90.0), F.lit(100.0))) == pytest.approx(-0.1)
    assert one(spark, S.revision_magnitude(F.lit(-10.0), F.lit(-5.0))) == 0.5
    assert one(spark, S.execution_gap(F.lit(0.0), F.lit(5.0))) is None


def test_fusion(spark):
    states = [("NORMAL", "OBSERVE", 0), ("NORMAL", "WARNING", 1), ("WARNING", "NORMAL", 2), ("BREAK_CONFIRMED", "WARNING", 3)]
    for r, p, code in states:
        assert one(spark, S.dual_state_code(F.lit(r), F.lit(p))) == code
        assert one(spark, S.dual_state(F.lit(r), F.lit(p))) == S.DUAL_STATES[code]
    assert one(spark, S.noisy_or(F.lit(0.4), F.lit(0.5))) == pytest.approx(0.7)
    assert one(spark, S.noisy_or(F.lit(1.1), F.lit(0.5))) is None


def test_codes_and_names(spark):
    assert one(spark, S.territory_code(F.lit("718-760-00 000"))) == "71876000"
    assert one(spark, S.territory_code(F.lit("71876000"))) == "71876000"
    assert one(spark, S.territory_code(F.lit("7187"))) is None
    assert one(spark, S.code_part(F.lit("7"), 3)) == "007"
    assert one(spark, S.code_part(F.lit("x"), 3)) == ""
    assert one(spark, S.name_key(F.lit(" Г.  Орёл-2 "))) == "г орел 2"
    assert spark.range(1).select(nfkc_name_key(F.lit("Ⅻ город")).alias("k")).first()["k"] == "xii город"


def test_growth_round_trip(spark):
    df = spark.createDataFrame([(110.0, 100.0), (0.0, 100.0), (5.0, 0.0)], "y double, l double")
    out = df.select(S.log_growth("y", "l").alias("g"), "l").select("g", S.from_log_growth("l", "g").alias("p")).collect()
    assert out[0]["p"] == pytest.approx(110.0)
    assert out[1]["g"] is None and out[2]["g"] is None
