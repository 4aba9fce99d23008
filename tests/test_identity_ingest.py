from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesora.operators import identity as idn
from tesora.operators import spending as sp

SOURCE = "spending_export"


def registry(spark, rows=(("71876000", "город Сургут"), ("71874000", "город Нефтеюганск"))):
    df = spark.createDataFrame(list(rows), "oktmo string, municipality_name string")
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in idn.REGISTRY_COLUMNS])


def aliases(spark, rows):
    df = spark.createDataFrame(rows, "source_municipality_name string, oktmo string, status string")
    return df.select(*[F.col(c) if c in df.columns else F.lit(SOURCE if c == "source_id" else "").alias(c) for c in idn.ALIAS_COLUMNS])


def both(spark, alias_rows=(("Сургут", "71876000000", "approved"), ("Нефтеюганск", "71874000", "PENDING"))):
    return idn.read_registry(registry(spark)).clean, idn.read_aliases(aliases(spark, list(alias_rows))).clean


def export(spark, rows):
    df = spark.createDataFrame(rows, "period string, value string, category_15 string, mo string")
    fixed = {"obs_status": "A", "source": "s", "freq": "M", "decimals": "2", "unit_measure": "RUB", "unit_mult": "0"}
    return df.withColumns({k: F.lit(v) for k, v in fixed.items()})


def test_registry_checks(spark):
    bad = registry(spark, [("71876000", "a"), ("718 76 000", "b"), ("12", "c"), ("71874000", "d")])
    parts = idn.read_registry(bad)
    assert [r["oktmo"] for r in parts.clean.collect()] == ["71874000"]
    assert sorted(r["reason_code"] for r in parts.quarantine.collect()) == ["BAD_CODE", "DUPLICATE_KEY"]
    with pytest.raises(ValueError):
        idn.read_registry(bad.drop("status"))


def test_resolution_uses_approved_aliases_only(spark, rows):
    reg, al = both(spark)
    names = spark.createDataFrame([(" сургут",), ("Нефтеюганск",), ("Неизвестный",)], "mo string")
    got = {r["mo"].strip(): r for r in idn.resolve_names(names, name="mo", source_id=SOURCE, registry=reg, aliases=al).collect()}
    assert got["сургут"]["oktmo"] == "71876000" and got["сургут"]["municipality_name"] == "город Сургут"
    assert got["Нефтеюганск"]["identity_status"] == "UNRESOLVED"
    assert got["Неизвестный"]["identity_reason"] == "NO_APPROVED_OKTMO_ALIAS"
    other = idn.resolve_names(names, name="mo", source_id="another", registry=reg, aliases=al)
    assert other.where("identity_status = 'OKTMO_RESOLVED'").count() == 0


def test_identity_problems(spark):
    reg, al = both(spark, [("Город", "71876000", "APPROVED"), ("город", "71874000", "VERIFIED"), ("Х", "99999999", "APPROVED")])
    got = {(r["problem"], r["item"]) for r in idn.identity_problems(reg, al).collect()}
    assert got == {("UNKNOWN_CODE", "99999999"), ("ALIAS_WITH_SEVERAL_CODES", f"{SOURCE}|город")}
    names = spark.createDataFrame([("ГОРОД",)], "mo string")
    assert idn.resolve_names(names, name="mo", source_id=SOURCE, registry=reg, aliases=al).first()["oktmo"] == ""


def test_alias_proposal(spark):
    reg = idn.read_registry(registry(spark, [("71876000", "Сургут"), ("71874000", "Лесной"), ("71875000", "лесной")])).clean
    names = spark.createDataFrame([("сургут ",), ("Лесной",), ("Иное",)], "mo string")
    parts = idn.propose_aliases(names, name="mo", source_id=SOURCE, registry=reg)
    assert [(r["oktmo"], r["match_method"]) for r in parts.clean.collect()] == [("71876000", "EXACT_UNIQUE_NAME")]
    assert sorted(r["source_municipality_name"] for r in parts.quarantine.collect()) == ["Иное", "Лесной"]


def test_registry_build(spark):
    raw = spark.createDataFrame(
        [("71", "876", "000", "000", "Сургут"), ("71", "876", "0", "", "Сургут"), ("71", "874", "000", "1", "А"), ("71", "874", "000", "2", "Б"), ("x", "1", "1", "", "В")],
        "`ТЕР` string, `Код1` string, `код2` string, kod3 string, `Наименование  территории` string",
    )
    parts = idn.build_registry(raw, source_id="list", source_url="u", source_version="v")
    row = parts.clean.collect()
    assert [(r["oktmo"], r["oktmo_full"], r["municipality_name"], r["region_code"]) for r in row] == [("71876000", "71876000000", "Сургут", "71")]
    assert [r["oktmo"] for r in parts.quarantine.collect()] == ["71874000"]
    assert list(parts.clean.columns) == list(idn.REGISTRY_COLUMNS)


def test_canonical_rows_and_profile(spark):
    reg, al = both(spark)
    rows = [
        ("2024-01-01", "10,5", "Все категории", "Сургут "),
        ("2024-01-01", "10,5", "Все категории", "Сургут "),
        ("2024-02-01", "11", "Все категории", "Сургут"),
        ("2024-02-01", "7", "Транспорт", "Неизвестный"),
    ]
    out = sp.canonicalize(export(spark, rows), registry=reg, aliases=al, source_id=SOURCE)
    got = out.canonical.orderBy("period_start").collect()
    assert [(r["oktmo"], r["category_code"], r["spending_nominal"], str(r["period_end"])) for r in got] == [
        ("71876000", "ALL", 10.5, "2024-01-31"),
        ("71876000", "ALL", 11.0, "2024-02-29"),
    ]
    assert tuple(out.canonical.columns) == sp.CANONICAL_COLUMNS
    p = out.profile.first()
    assert (p["input_rows"], p["exact_duplicates_removed"], p["canonical_rows"], p["quarantined_rows"], p["unresolved_rows"]) == (4, 1, 2, 1, 1)
    assert (p["ambiguous_names"], p["periods"], p["categories"], str(p["period_start"])) == (0, 2, 1, "2024-01-01")


def test_ambiguous_name_goes_aside_with_all_rows(spark):
    reg, al = both(spark)
    rows = [("2024-01-01", "1", "Все категории", "Сургут"), ("2024-01-01", "2", "Все категории", "Сургут"), ("2024-02-01", "3", "Транспорт", "Сургут")]
    out = sp.canonicalize(export(spark, rows), registry=reg, aliases=al, source_id=SOURCE)
    assert out.canonical.count() == 0
    assert {(r["identity_status"], r["identity_reason"]) for r in out.quarantine.collect()} == {
        ("AMBIGUOUS_SOURCE_NAME", "DUPLICATE_PERIOD_CATEGORY_NAME_IN_SOURCE")
    }
    assert out.profile.first()["ambiguous_names"] == 1


def test_bad_export_rows(spark):
    rows = [("x", "1", "Транспорт", "a"), ("2024-01-01", "?", "Транспорт", "a"), ("2024-01-01", "-1", "Транспорт", "a"), ("2024-01-01", "1", "Иное", "a"), ("2024-01-01", "1", "Транспорт", " ")]
    got = sorted(r["reason_code"] for r in sp.check_export(export(spark, rows)).quarantine.collect())
    assert got == ["BAD_PERIOD", "BAD_VALUE", "BLANK_NAME", "NEGATIVE_VALUE", "UNKNOWN_CATEGORY"]
    with pytest.raises(ValueError, match="unit_mult"):
        sp.check_export(export(spark, rows).drop("unit_mult"))


def test_two_names_of_one_code_clash(spark):
    reg, al = both(spark, [("Сургут", "71876000", "APPROVED"), ("г. Сургут", "71876000", "APPROVED")])
    rows = [("2024-01-01", "1", "Транспорт", "Сургут"), ("2024-01-01", "2", "Транспорт", "г. Сургут")]
    out = sp.canonicalize(export(spark, rows), registry=reg, aliases=al, source_id=SOURCE)
    assert out.canonical.count() == 0
    assert [r["reason_code"] for r in out.rejected.collect()] == ["DUPLICATE_KEY"]


def test_peer_panel(spark):
    peers = spark.createDataFrame([("Сургут", "71876000"), ("А", "1"), ("Б", "1")], "mo string, oktmo string")
    rows = [("2024-01-01", "1", "Транспорт", " Сургут"), ("2024-02-01", "1", "Транспорт", "Сургут"), ("2024-02-01", "2", "Транспорт", "Сургут"), ("2024-01-01", "1", "Транспорт", "А")]
    parts = sp.peer_panel(export(spark, rows), peers)
    assert [r["oktmo"] for r in parts.clean.collect()] == ["71876000"] and parts.quarantine.count() == 1


def test_a_text_is_parsed_once_whatever_the_rules(spark):
    from tesora.operators import spending as sp

    columns = ", ".join(f"{c} string" for c in sp.EXPORT_COLUMNS)
    row = ("2024-01-01", "1 234,50", "A", "s", "Транспорт", " x ", "M", "2", "RUB", "0")
    rows = [row, row[:1] + ("-1",) + row[2:], ("13.2020",) + row[1:], row[:1] + ("1e999",) + row[2:]]
    parts = sp.check_export(spark.createDataFrame(rows, columns))
    assert [(r.value, r.mo) for r in parts.clean.collect()] == [(1234.5, "x")]
    assert sorted(r.reason_code for r in parts.quarantine.collect()) == ["BAD_PERIOD", "BAD_VALUE", "NEGATIVE_VALUE"]
    assert sorted(str(r.reason_code) for r in parts.marked.collect()) == ["BAD_PERIOD", "BAD_VALUE", "NEGATIVE_VALUE", "None"]
    for side in (parts.clean, parts.quarantine):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_replace(") == 1 and plan.count("try_cast(period") == 1


def test_the_export_is_read_once_for_rows_and_names(spark, monkeypatch):
    real, plans = sp.materialize, []

    def seen(df, purpose):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df, purpose)

    monkeypatch.setattr(sp, "materialize", seen)
    registry_, aliases_ = both(spark)
    rows = export(spark, [("2024-01-01", "5", "Транспорт", "Сургут")] * 2 + [("2024-01-01", "7", "Транспорт", "Other")])
    tables = sp.canonicalize(rows, registry=registry_, aliases=aliases_, source_id=SOURCE)
    assert [r.spending_nominal for r in tables.canonical.collect()] == [5.0]
    assert [sum("regexp_replace(value" in line for line in p.splitlines()) for p in plans] == [1, 0]
