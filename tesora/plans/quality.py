"""Queries on dataset contracts, publication dates, visibility and source history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesora.operators import datasets as ds
from tesora.operators import temporal as tm
from tesora.plans import inputs as data
from tesora.plans.registry import query, rounded, sql_round as r
from tesora.sources import publish as pb
from tesora.sources import store as st


def _counts_sql(rules: dict[str, tuple[str, str]], source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS rule, '{severity}' AS severity, CAST(({expr}) AS BIGINT) AS n" + (f" FROM {source}" if "count(" in expr else "")
        for name, (severity, expr) in rules.items()
    )


def _where(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


_CORE_COLUMNS = ("year", "municipality_name", *[
    "tax_initial", "nontax_initial", "tax_actual", "nontax_actual", "program_expense", "total_expense",
    "budget_amendments", "municipal_debt", "own_revenue_base"])
_CORE_RULES = {
    "BLANK_NAME": ("ERROR", "0"),
    "NUMERIC_NAME": ("ERROR", _where("regexp_full_match(municipality_name, '[0-9]+')")),
    "BAD_YEAR": ("ERROR", "0"),
    "PROGRAM_ABOVE_TOTAL": ("WARNING", _where("program_expense > total_expense")),
    "NEGATIVE_MUNICIPAL_DEBT": ("WARNING", _where("municipal_debt < 0")),
    "NEGATIVE_OWN_REVENUE_BASE": ("WARNING", _where("own_revenue_base < 0")),
    "NEGATIVE_TOTAL_EXPENSE": ("WARNING", _where("total_expense < 0")),
    "MISSING_REQUIRED_CELL": ("ERROR", " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _CORE_COLUMNS)),
    "EMPTY_TABLE": ("ERROR", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"),
    "MISSING_COLUMN": ("ERROR", "0"),
    "DUPLICATE_COLUMN": ("ERROR", "0"),
    "EXTRA_COLUMN": ("WARNING", "1"),
}
_CORE_TWISTED_SQL = f"""{data.FISCAL_CORE_SQL},
twisted AS (SELECT * REPLACE (CASE WHEN year = 1999 THEN NULL ELSE program_expense * CASE WHEN year = 1997 THEN 3 ELSE 1 END END AS program_expense,
  CASE WHEN year = 1998 THEN -municipal_debt ELSE municipal_debt END AS municipal_debt) FROM core)"""


def _core(spark, sf):
    year = F.col("year")
    program = F.when(year == 1999, F.lit(None)).otherwise(F.col("program_expense") * F.when(year == 1997, 3).otherwise(1))
    debt = F.when(year == 1998, -F.col("municipal_debt")).otherwise(F.col("municipal_debt"))
    return data.fiscal_core(spark, sf).withColumns({"program_expense": program, "municipal_debt": debt})


_CORE_REPORT_SQL = f"""{_CORE_TWISTED_SQL}, report AS ({_counts_sql(_CORE_RULES, 'twisted')}
UNION ALL SELECT 'DUPLICATE_KEY', 'WARNING', CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM twisted GROUP BY year, municipality_name))"""


@query("validation_reference_core", f"WITH {_CORE_REPORT_SQL} SELECT * FROM report")
def validation_reference_core(spark, sf):
    return ds.validation_report(_core(spark, sf), "reference_core")


@query(
    "dataset_status",
    f"""WITH {_CORE_REPORT_SQL} SELECT 'reference_core' AS dataset_key, 'uploaded' AS mode, count(*) AS row_count, count(DISTINCT municipality_name) AS entities,
  min(year) || '–' || max(year) AS period_label, (SELECT CASE WHEN sum(n) FILTER (severity = 'ERROR') > 0 THEN 'REJECTED' WHEN sum(n) > 0 THEN 'REVIEW' ELSE 'ACCEPTED' END FROM report) AS quality
FROM twisted""",
)
def dataset_status(spark, sf):
    return ds.dataset_status(_core(spark, sf), "reference_core", uploaded=True)


_LINE_RULES = {
    "BLANK_NAME": ("ERROR", _where("year = 1996")),
    "NUMERIC_NAME": ("ERROR", "0"),
    "BAD_YEAR": ("ERROR", _where("year = 1995")),
    "BAD_AMOUNT": ("ERROR", _where("grp = 'PROMO'")),
    "NEGATIVE_AMOUNT": ("ERROR", _where("grp = 'LARGE'")),
    "UNKNOWN_SIDE": ("ERROR", _where("budget_side = 'EXCEPTION'")),
    "UNKNOWN_FLEXIBILITY": ("ERROR", "0"),
    "MISSING_REQUIRED_CELL": ("ERROR", _where("grp = 'PROMO'")),
    "EMPTY_TABLE": ("ERROR", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"),
    "MISSING_COLUMN": ("ERROR", "0"),
    "DUPLICATE_COLUMN": ("ERROR", "0"),
    "EXTRA_COLUMN": ("WARNING", "0"),
}


@query(
    "validation_budget_project",
    f"""WITH {data.BUDGET_LINES_SQL}, w AS (SELECT *, CASE WHEN year = 1995 THEN 'n/a' ELSE CAST(year AS VARCHAR) END AS ytext,
  CASE WHEN year = 1996 THEN ' ' ELSE municipality_name END AS nm FROM lines)
{_counts_sql(_LINE_RULES, 'lines')}
UNION ALL SELECT 'DUPLICATE_KEY', 'WARNING', CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM w
  GROUP BY ytext, nm, CASE WHEN budget_side = 'EXCEPTION' THEN 'RESERVE' ELSE budget_side END, grp, item_name)""",
)
def validation_budget_project(spark, sf):
    lines = data.budget_lines(spark, sf)
    year = F.col("year")
    twisted = lines.withColumns(
        {
            "amount": F.when(F.col("group") == "PROMO", F.lit(None)).when(F.col("group") == "LARGE", -F.col("amount")).otherwise(F.col("amount")),
            "municipality_name": F.when(year == 1996, " ").otherwise(F.col("municipality_name")),
            "budget_side": F.when(F.col("budget_side") == "EXCEPTION", "RESERVE").otherwise(F.col("budget_side")),
            "flexibility": F.lower("flexibility"),
            "year": F.when(year == 1995, "n/a").otherwise(year.cast("string")),
        }
    )
    return ds.validation_report(twisted, "budget_project")


_EXT_RULES = {
    "BAD_PERIOD": ("ERROR", "0"),
    "BAD_PUBLICATION_DATE": ("ERROR", _where("variable = 'error'")),
    "BAD_AS_OF_DATE": ("ERROR", "0"),
    "BAD_VALUE": ("ERROR", _where("variable = 'signup'")),
    "AS_OF_BEFORE_PUBLICATION": ("WARNING", _where("variable <> 'error' AND as_of_date < publication_date")),
    "MISSING_REQUIRED_CELL": ("ERROR", "0"),
    "EMPTY_TABLE": ("ERROR", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"),
    "DUPLICATE_KEY": ("WARNING", "0"),
    "MISSING_COLUMN": ("ERROR", "0"),
    "DUPLICATE_COLUMN": ("ERROR", "0"),
    "EXTRA_COLUMN": ("WARNING", "0"),
}


@query("validation_external", f"WITH {data.EXTERNAL_SQL}\n{_counts_sql(_EXT_RULES, 'ext')}")
def validation_external(spark, sf):
    df = data.external(spark, sf)
    twisted = df.withColumns(
        {
            "publication_date": F.when(F.col("variable") == "error", "soon").otherwise(F.col("publication_date").cast("string")),
            "value": F.when(F.col("variable") == "signup", "-").otherwise(F.col("value").cast("string")),
        }
    )
    return ds.validation_report(twisted, "external_monthly")


_PLAN_AMOUNT_RULES = {}
for _c in ds.PLAN_AMOUNTS:
    _PLAN_AMOUNT_RULES[f"BAD_{_c.upper()}"] = ("ERROR", _where("st = 'F'") if _c == "transfers" else "0")
    _PLAN_AMOUNT_RULES[f"NEGATIVE_{_c.upper()}"] = ("ERROR", _where("v < 100000") if _c == "deficit" else "0")


@query(
    "validation_official_plan",
    f"""WITH p AS (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus AS st, {data.money_sql("o_totalprice")} AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
{_counts_sql({
    "BLANK_NAME": ("ERROR", "0"), "NUMERIC_NAME": ("ERROR", "0"), "BAD_YEAR": ("ERROR", "0"), **_PLAN_AMOUNT_RULES,
    "TOTAL_MISMATCH": ("WARNING", _where("st <> 'F' AND v * 0.01 > greatest(v, 1.0) * 0.001 AND y >= 1998")),
    "DEFICIT_MISMATCH": ("WARNING", _where("abs(v * 0.2 - CASE WHEN v < 100000 THEN -5.0 ELSE v * 0.2 END) > greatest(v * 0.2, 1.0) * 0.001")),
    "MISSING_REQUIRED_CELL": ("ERROR", _where("st = 'F'")), "EMPTY_TABLE": ("ERROR", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"),
    "DUPLICATE_KEY": ("WARNING", "0"), "MISSING_COLUMN": ("ERROR", "1"), "DUPLICATE_COLUMN": ("ERROR", "0"), "EXTRA_COLUMN": ("WARNING", "1")}, 'p')}""",
)
def validation_official_plan(spark, sf):
    v = F.col("v")
    plan = (
        data.at_buyer(spark, sf, data.read(spark, sf, "orders"))
        .groupBy(F.year("o_orderdate").alias("year"), F.col("n_name").alias("municipality_name"), F.col("o_orderstatus").alias("stage"))
        .agg(data.money("o_totalprice").alias("v"))
        .select(
            "year",
            "municipality_name",
            "stage",
            v.alias("total_revenue"),
            (v * 0.75).alias("revenue_base"),
            F.lit(0.0).alias("additional_ndfl"),
            (v * 0.75).alias("legal_deficit_base"),
            F.when(F.col("stage") == "F", F.lit(None).cast("double"))
            .otherwise(v * 0.25 + F.when(F.col("year") >= 1998, v * 0.01).otherwise(0.0))
            .alias("transfers"),
            (v * 1.2).alias("expenditure"),
            F.when(v < 100000, -5.0).otherwise(v * 0.2).alias("deficit"),
            F.lit(0.0).alias("financing_sources"),
            F.lit(0.0).alias("eligible_exceptions"),
            F.lit("u").alias("source_url"),
            F.lit("x").alias("spare"),
        )
    )
    return ds.validation_report(plan, "budget_official_plan")


@query(
    "dataset_summary",
    f"""WITH {data.EXTERNAL_SQL} SELECT count(*) AS row_count, 9 AS column_count, count(DISTINCT geography_name) AS entities,
  CASE WHEN strftime(min(period), '%Y-%m') = strftime(max(period), '%Y-%m') THEN strftime(min(period), '%Y-%m') ELSE strftime(min(period), '%Y-%m') || '–' || strftime(max(period), '%Y-%m') END AS period_label FROM ext""",
)
def dataset_summary(spark, sf):
    return ds.dataset_summary(data.external(spark, sf))


# ---- publication dates -------------------------------------------------------


@query(
    "asof_violations",
    f"""WITH {data.EXTERNAL_SQL} SELECT geography_name, variable, count(*) AS late_rows FROM ext WHERE publication_date > DATE '2024-01-25' GROUP BY 1, 2""",
)
def asof_violations(spark, sf):
    late = tm.asof_violations(data.external(spark, sf), "2024-01-25")
    return late.groupBy(F.trim("geography_name").alias("geography_name"), "variable").agg(F.count(F.lit(1)).alias("late_rows"))


@query(
    "asof_violations_by_row",
    f"""WITH {data.EXTERNAL_SQL} SELECT period, geography_name, variable FROM ext WHERE publication_date > as_of_date""",
)
def asof_violations_by_row(spark, sf):
    late = tm.asof_violations(data.external(spark, sf), F.col("as_of_date"))
    return late.select("period", F.trim("geography_name").alias("geography_name"), "variable")


@query(
    "asof_features",
    f"""WITH {data.AGGREGATES_SQL}, good AS (SELECT * FROM agg WHERE available_at >= period),
k AS (SELECT oktmo, category, indicator, source, count(*) AS n, arg_max(value, period) AS value, arg_max(available_at, period) AS available_at FROM good
  WHERE available_at <= TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3, 4)
SELECT oktmo, TIMESTAMP '2024-01-20' AS prediction_date, available_at, category, indicator, value, source FROM k""",
)
def asof_features(spark, sf):
    return tm.features_as_of(tm.check_aggregates(data.aggregates(spark, sf)).clean, "2024-01-20", mode="latest").clean


@query(
    "asof_repeats",
    f"""WITH {data.AGGREGATES_SQL}, good AS (SELECT * FROM agg WHERE available_at >= period)
SELECT oktmo, category, indicator, count(*) AS n_rows FROM good WHERE available_at <= TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3, source HAVING count(*) > 1""",
)
def asof_repeats(spark, sf):
    parts = tm.features_as_of(tm.check_aggregates(data.aggregates(spark, sf)).clean, "2024-01-20")
    return parts.quarantine.select("oktmo", "category", "indicator", "n_rows")


def _bad_aggregates(spark, sf):
    df = data.aggregates(spark, sf)
    twisted = df.withColumns(
        {
            "oktmo": F.when(F.col("indicator") == "error", F.substring("oktmo", 2, 7)).otherwise(F.col("oktmo")),
            "category": F.when((F.col("category") == "transport") & (F.col("indicator") == "view"), "rent").otherwise(F.col("category")),
        }
    )
    return twisted.unionByName(twisted.where((F.col("indicator") == "click") & (F.col("category") == "food")))


@query(
    "aggregate_contract",
    f"""WITH {data.AGGREGATES_SQL}, t AS (SELECT *, CASE WHEN indicator = 'error' THEN 'BAD_CODE' WHEN category = 'transport' AND indicator = 'view' THEN 'UNKNOWN_CATEGORY'
  WHEN available_at < period THEN 'RELEASE_BEFORE_PERIOD' WHEN indicator = 'click' AND category = 'food' THEN 'DUPLICATE_KEY' ELSE 'clean' END AS verdict FROM agg)
SELECT verdict, CAST(sum(CASE WHEN indicator = 'click' AND category = 'food' THEN 2 ELSE 1 END) AS BIGINT) AS n FROM t GROUP BY 1""",
)
def aggregate_contract(spark, sf):
    parts = tm.check_aggregates(_bad_aggregates(spark, sf))
    both = parts.clean.select(F.lit("clean").alias("verdict")).unionByName(
        parts.quarantine.select(F.col("reason_code").alias("verdict"))
    )
    return both.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "external_series",
    f"WITH {data.EXTERNAL_SQL} SELECT period, value, unit, source, publication_date, as_of_date FROM ext WHERE geography_name = 'user-7' AND variable = 'purchase'",
)
def external_series(spark, sf):
    return tm.extract_series(tm.normalize_external(data.external(spark, sf)).clean, geography="user-7", variable="purchase")


@query(
    "external_coverage",
    f"""WITH {data.EXTERNAL_SQL} SELECT count(*) AS rows, count(DISTINCT geography_name) AS geographies, count(DISTINCT variable) AS variables,
  strftime(min(period), '%Y-%m-%d') AS start_period, strftime(max(period), '%Y-%m-%d') AS end_period FROM ext""",
)
def external_coverage(spark, sf):
    return tm.coverage(tm.normalize_external(data.external(spark, sf)).clean)


# ---- visibility and source history -------------------------------------------

_CLASSES = ("PUBLIC", "INTERNAL", "RESTRICTED", "BANK_CONFIDENTIAL", "SECRET")


@query(
    "class_visibility",
    f"""WITH c AS (SELECT o_orderkey, CASE o_orderpriority {' '.join(f"WHEN '{p}' THEN '{k}'" for p, k in zip(('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'), _CLASSES))} END AS data_class FROM orders),
g AS (SELECT role, data_class, count(*) AS visible_rows FROM c, (VALUES ('BUSINESS_USER', 1), ('AUDITOR', 3), ('SECURITY_ADMIN', -1), ('GUEST', -1)) r(role, top)
  WHERE top >= CASE data_class WHEN 'PUBLIC' THEN 0 WHEN 'INTERNAL' THEN 1 WHEN 'RESTRICTED' THEN 2 WHEN 'BANK_CONFIDENTIAL' THEN 3 ELSE 999 END GROUP BY 1, 2)
SELECT * FROM g""",
)
def class_visibility(spark, sf):
    label = F.lit(None).cast("string")
    for p, k in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), _CLASSES):
        label = F.when(F.col("o_orderpriority") == p, k).otherwise(label)
    rows = data.read(spark, sf, "orders").select("o_orderkey", label.alias("data_class"))
    out = None
    for role in ("BUSINESS_USER", "AUDITOR", "SECURITY_ADMIN", "GUEST"):
        seen = st.visible_to(rows, role).groupBy(F.lit(role).alias("role"), "data_class").agg(F.count(F.lit(1)).alias("visible_rows"))
        out = seen if out is None else out.unionByName(seen)
    return out


def _history(spark, sf):
    status = (
        F.when(F.col("turn") == 0, "candidate")
        .when(F.col("role") == "assistant", "connected")
        .when(F.length("text") < 40, "rejected")
        .otherwise("validated")
    )
    return data.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("source_id"),
        F.col("turn").alias("seq"),
        status.alias("status"),
        F.col("role").alias("actor"),
        F.when(F.length("text") > 60, F.col("text")).alias("evidence"),
        F.when(F.length("text") > 300, "digest").alias("artifact_sha256"),
        F.when(F.length("text") > 150, "report").alias("validation_report"),
    )


_HISTORY_SQL = """h AS (SELECT conv_id AS source_id, turn AS seq, role, length(text) AS len, CASE WHEN turn = 0 THEN 'candidate' WHEN role = 'assistant' THEN 'connected'
  WHEN length(text) < 40 THEN 'rejected' ELSE 'validated' END AS status FROM conversations),
p AS (SELECT *, lag(status) OVER (PARTITION BY source_id ORDER BY seq) AS previous FROM h)"""


@query(
    "source_transitions",
    f"""WITH {_HISTORY_SQL} SELECT source_id, seq, previous, status, CASE
  WHEN previous IS NOT NULL AND len <= 60 THEN 'MISSING_EVIDENCE'
  WHEN previous IS NOT NULL AND NOT ((previous = 'candidate' AND status IN ('connected', 'rejected')) OR (previous = 'connected' AND status IN ('validated', 'rejected'))
    OR (previous = 'validated' AND status IN ('connected', 'rejected')) OR (previous = 'rejected' AND status = 'candidate')) THEN 'TRANSITION_NOT_ALLOWED'
  WHEN status = 'connected' AND len <= 300 THEN 'MISSING_DIGEST' WHEN status = 'validated' AND len <= 150 THEN 'MISSING_REPORT' END AS problem FROM p""",
)
def source_transitions(spark, sf):
    return pb.check_transitions(_history(spark, sf))


@query("current_source_status", f"WITH {_HISTORY_SQL} SELECT source_id, arg_max(status, seq) AS status, max(seq) AS seq FROM h GROUP BY 1")
def current_source_status(spark, sf):
    return pb.current_status(_history(spark, sf))
