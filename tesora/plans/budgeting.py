"""Queries on budget lines, the budget result and its scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesora.operators import budget as bg
from tesora.operators.contracts import split
from tesora.plans import inputs as data
from tesora.plans.registry import query, rounded, sql_round as r

KEY = ["municipality_name", "year"]
SUMS = (
    "revenue_base",
    "transfers",
    "expenditure",
    "recurring_revenue",
    "recurring_expenditure",
    "financing_sources",
    "eligible_exceptions",
    "planned_net_borrowing",
    "debt_service",
    "expenditure_ex_subventions",
)


def _if(cond: str) -> str:
    return f"coalesce({data.money_sql(f'CASE WHEN {cond} THEN amount END')}, 0.0)"


SUMMARY_SQL = f"""{data.BUDGET_LINES_SQL},
summary AS (SELECT municipality_name, year, count(*) AS n_lines,
  {_if("budget_side = 'REVENUE' AND NOT is_transfer")} AS revenue_base, {_if("budget_side = 'REVENUE' AND is_transfer")} AS transfers,
  {_if("budget_side = 'EXPENDITURE'")} AS expenditure, {_if("budget_side = 'REVENUE' AND is_recurring")} AS recurring_revenue,
  {_if("budget_side = 'EXPENDITURE' AND is_recurring")} AS recurring_expenditure, {_if("budget_side = 'FINANCING'")} AS financing_sources,
  {_if("budget_side = 'EXCEPTION'")} AS eligible_exceptions, {_if("budget_side = 'FINANCING' AND is_borrowing")} AS planned_net_borrowing,
  {_if("budget_side = 'EXPENDITURE' AND is_debt_service")} AS debt_service,
  {_if("budget_side = 'EXPENDITURE' AND NOT is_subvention")} AS expenditure_ex_subventions
  FROM lines GROUP BY 1, 2)"""

# limits per nation: the debt grows with the nation's number, the ratios are the defaults
LIMITS_SQL = """inputs AS (SELECT summary.*, n_nationkey * 50000.0::DOUBLE AS current_debt, 0.10::DOUBLE AS deficit_limit_ratio,
  1.0::DOUBLE AS debt_limit_ratio, 0.15::DOUBLE AS debt_service_limit_ratio, revenue_base AS deficit_base
  FROM summary JOIN nation ON municipality_name = n_name)"""


def _result_sql(source: str, name: str) -> str:
    def ratio(num: str, den: str) -> str:
        return f"CASE WHEN {den} > 0 THEN {num} / {den} ELSE 0 END"

    return f"""{name}0 AS (SELECT *, revenue_base + transfers AS total_revenue, revenue_base + transfers - expenditure AS balance,
  greatest(expenditure - revenue_base - transfers, 0) AS deficit, deficit_base * deficit_limit_ratio AS base_deficit_limit,
  recurring_revenue - recurring_expenditure AS recurring_balance, greatest(recurring_expenditure - recurring_revenue, 0) AS structural_gap,
  greatest(current_debt + planned_net_borrowing, 0) AS debt_after,
  CASE WHEN expenditure_ex_subventions > 0 THEN expenditure_ex_subventions ELSE expenditure END AS service_base FROM {source}),
{name} AS (SELECT *, {ratio("deficit", "deficit_base")} AS deficit_ratio, base_deficit_limit + eligible_exceptions AS allowed_deficit,
  greatest(deficit - base_deficit_limit, 0) AS raw_normalization_gap, greatest(deficit - base_deficit_limit - eligible_exceptions, 0) AS normalization_gap,
  greatest(deficit - financing_sources, 0) AS financing_gap, {ratio("debt_after", "revenue_base")} AS debt_ratio,
  revenue_base * debt_limit_ratio - debt_after AS debt_headroom, {ratio("debt_service", "service_base")} AS debt_service_ratio,
  deficit <= base_deficit_limit + eligible_exceptions AS deficit_within_configured_limit,
  {ratio("debt_after", "revenue_base")} <= debt_limit_ratio AS debt_within_configured_limit,
  {ratio("debt_service", "service_base")} <= debt_service_limit_ratio AS debt_service_within_configured_limit FROM {name}0)"""


BASE_SQL = f"{SUMMARY_SQL}, {LIMITS_SQL}, {_result_sql('inputs', 'result')}"
AMOUNTS = (
    "total_revenue",
    "balance",
    "deficit",
    "base_deficit_limit",
    "allowed_deficit",
    "raw_normalization_gap",
    "normalization_gap",
    "recurring_balance",
    "structural_gap",
    "financing_gap",
    "debt_after",
    "debt_headroom",
)
RATIOS = ("deficit_ratio", "debt_ratio", "debt_service_ratio")
CHECKS = ("deficit_within_configured_limit", "debt_within_configured_limit", "debt_service_within_configured_limit")


def _lines(spark, sf):
    return bg.normalize_lines(data.budget_lines(spark, sf)).clean


def _inputs(spark, sf, lines=None):
    limits = data.read(spark, sf, "nation").select(
        F.col("n_name").alias("municipality_name"), (F.col("n_nationkey") * 50000.0).alias("current_debt")
    )
    return bg.to_inputs(bg.summarize(lines or _lines(spark, sf)), limits)


def _result(spark, sf, lines=None):
    return bg.budget_result(split(_inputs(spark, sf, lines), bg.input_rules()).clean)


@query(
    "budget_lines_by_side",
    f"""WITH {data.BUDGET_LINES_SQL} SELECT budget_side, flexibility, is_transfer, count(*) AS n_lines, {r("sum(amount)", 2)} AS amount
FROM lines GROUP BY 1, 2, 3""",
)
def budget_lines_by_side(spark, sf):
    raw = data.budget_lines(spark, sf)
    words = F.when(F.col("is_transfer"), " Да ").otherwise("no")
    typed = raw.withColumns(
        {
            "budget_side": F.concat(F.lit(" "), F.lower("budget_side")),
            "is_transfer": words,
            "is_recurring": F.col("is_recurring").cast("int"),
            "flexibility": F.when(F.col("flexibility") != "UNKNOWN", F.lower("flexibility")),
        }
    )
    clean = bg.normalize_lines(typed).clean
    out = clean.groupBy("budget_side", "flexibility", "is_transfer").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("amount").alias("amount")
    )
    return rounded(out, 2, "amount")


@query(
    "rejected_budget_lines",
    """SELECT CASE WHEN year < 1996 THEN 'UNKNOWN_SIDE' WHEN l_discount > 0.05 THEN 'NEGATIVE_AMOUNT' ELSE 'UNKNOWN_FLEXIBILITY' END AS reason_code,
  count(*) AS n_lines
FROM (SELECT year(l_shipdate) AS year, l_discount, l_tax FROM lineitem)
WHERE year < 1996 OR l_discount > 0.05 OR l_tax > 0.05 GROUP BY 1""",
)
def rejected_budget_lines(spark, sf):
    items = data.read(spark, sf, "lineitem")
    raw = items.select(
        F.year("l_shipdate").alias("year"),
        F.lit("x").alias("municipality_name"),
        F.when(F.year("l_shipdate") < 1996, "INCOME").otherwise("REVENUE").alias("budget_side"),
        F.lit("g").alias("group"),
        F.lit("i").alias("item_name"),
        F.when(F.col("l_discount") > 0.05, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("amount"),
        F.when(F.col("l_tax") > 0.05, "ELASTIC").otherwise("fixed ").alias("flexibility"),
    )
    bad = bg.normalize_lines(raw).quarantine
    return bad.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "budget_summary",
    f"WITH {SUMMARY_SQL} SELECT municipality_name, year, n_lines AS rows, {', '.join(f'{r(c, 2)} AS {c}' for c in SUMS)} FROM summary",
)
def budget_summary(spark, sf):
    return rounded(bg.summarize(_lines(spark, sf)), 2, *SUMS)


@query(
    "budget_result",
    f"""WITH {BASE_SQL} SELECT municipality_name, year, {', '.join(f'{r(c, 3)} AS {c}' for c in AMOUNTS)},
  {', '.join(f'{r(c, 9)} AS {c}' for c in RATIOS)}, {', '.join(CHECKS)} FROM result""",
)
def budget_result(spark, sf):
    df = _result(spark, sf).select(*KEY, *AMOUNTS, *RATIOS, *CHECKS)
    return rounded(rounded(df, 3, *AMOUNTS), 9, *RATIOS)


@query(
    "invalid_budget_inputs",
    f"""WITH {SUMMARY_SQL} SELECT CASE WHEN revenue_base < 300000 THEN 'NEGATIVE_AMOUNT' WHEN year = 1995 THEN 'DEFICIT_LIMIT_RANGE'
  WHEN year = 1996 THEN 'DEBT_LIMIT_RANGE' ELSE 'SERVICE_LIMIT_RANGE' END AS reason_code, count(*) AS n_budgets
FROM summary WHERE revenue_base < 300000 OR year IN (1995, 1996, 1997) GROUP BY 1""",
)
def invalid_budget_inputs(spark, sf):
    df = bg.with_defaults(bg.summarize(_lines(spark, sf))).withColumns(
        {
            "current_debt": F.when(F.round("revenue_base", 2) < 300000, -1.0).otherwise(0.0),
            "deficit_limit_ratio": F.when(F.col("year") == 1995, 1.2).otherwise(0.1),
            "debt_limit_ratio": F.when(F.col("year") == 1996, 2.5).otherwise(1.0),
            "debt_service_limit_ratio": F.when(F.col("year") == 1997, -0.1).otherwise(0.15),
        }
    )
    bad = split(df, bg.input_rules()).quarantine
    return bad.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n_budgets"))


_CRITERIA = {
    "deficit": ("CASE WHEN normalization_gap <= 0 THEN 'OK' ELSE 'BREACH' END", "deficit_ratio",
                "deficit_limit_ratio + CASE WHEN revenue_base > 0 THEN eligible_exceptions / revenue_base ELSE 0 END", "allowed_deficit - deficit"),
    "structural": ("CASE WHEN structural_gap <= 0 THEN 'OK' ELSE 'WATCH' END", "recurring_balance", "0", "recurring_balance"),
    "financing": ("CASE WHEN financing_gap <= 0 THEN 'OK' ELSE 'WATCH' END", "financing_gap", "0", "-financing_gap"),
    "debt": ("CASE WHEN debt_within_configured_limit THEN 'OK' ELSE 'BREACH' END", "debt_ratio", "debt_limit_ratio", "debt_headroom"),
    "debt_service": ("CASE WHEN debt_service_within_configured_limit THEN 'OK' ELSE 'BREACH' END", "debt_service_ratio",
                     "debt_service_limit_ratio", "debt_service_limit_ratio - debt_service_ratio"),
}


@query(
    "budget_criteria",
    f"WITH {BASE_SQL} "
    + " UNION ALL ".join(
        f"SELECT municipality_name, year, '{code}' AS code, '{bg.CRITERIA_TITLES[code]}' AS title, {status} AS status, "
        f"{r(f'CAST({value} AS DOUBLE)', 5)} AS value, {r(f'CAST({limit} AS DOUBLE)', 8)} AS \"limit\", {r(f'CAST({head} AS DOUBLE)', 5)} AS headroom FROM result"
        for code, (status, value, limit, head) in _CRITERIA.items()
    ),
)
def budget_criteria(spark, sf):
    return rounded(rounded(bg.criteria(_result(spark, sf)), 5, "value", "headroom"), 8, "limit")


@query(
    "budget_scenarios",
    f"""WITH {SUMMARY_SQL}, {LIMITS_SQL}, changed AS (
  SELECT inputs.* REPLACE (greatest(revenue_base + s.a, 0) AS revenue_base, greatest(transfers + s.b, 0) AS transfers,
    greatest(expenditure + s.c, 0) AS expenditure, planned_net_borrowing + s.d AS planned_net_borrowing,
    greatest(revenue_base + s.a, 0) AS deficit_base), s.scenario
  FROM inputs, (VALUES ('growth', 100000.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('cut', 0.0, -1e7, -250000.0, -50000.0)) s(scenario, a, b, c, d)),
{_result_sql('changed', 'result')}
SELECT municipality_name, year, scenario, {r("total_revenue", 3)} AS total_revenue, {r("deficit", 3)} AS deficit,
  {r("normalization_gap", 3)} AS normalization_gap, {r("debt_after", 3)} AS debt_after, {r("debt_ratio", 9)} AS debt_ratio FROM result""",
)
def budget_scenarios(spark, sf):
    changes = [
        {"scenario": "growth", "revenue_base_change": 100000.0},
        {"scenario": "cut", "transfer_change": -1e7, "expenditure_change": -250000.0, "net_borrowing_change": -50000.0},
    ]
    df = bg.scenario(_inputs(spark, sf), changes).select(
        *KEY, "scenario", "total_revenue", "deficit", "normalization_gap", "debt_after", "debt_ratio"
    )
    return rounded(rounded(df, 3, "total_revenue", "deficit", "normalization_gap", "debt_after"), 9, "debt_ratio")


@query(
    "closing_scenarios",
    f"""WITH {BASE_SQL}, picked AS (SELECT municipality_name, year, revenue_base, transfers, expenditure, recurring_revenue, recurring_expenditure,
    financing_sources, eligible_exceptions, planned_net_borrowing, debt_service, expenditure_ex_subventions, current_debt, deficit_limit_ratio,
    debt_limit_ratio, debt_service_limit_ratio, normalization_gap AS gap FROM result),
moved AS (
  SELECT *, 'Доходы' AS scenario, gap / (1 + deficit_limit_ratio) AS a, 0.0 AS b, 0.0 AS c FROM picked
  UNION ALL SELECT *, 'Расходы', 0.0, 0.0, -gap FROM picked
  UNION ALL SELECT *, 'Сбалансированный', gap / 3 / (1 + deficit_limit_ratio), gap / 3, -gap / 3 FROM picked),
changed AS (SELECT * REPLACE (greatest(revenue_base + a, 0) AS revenue_base, greatest(transfers + b, 0) AS transfers,
  greatest(expenditure + c, 0) AS expenditure), greatest(revenue_base + a, 0) AS deficit_base FROM moved),
{_result_sql('changed', 'closed')}
SELECT municipality_name, year, scenario, {r("gap", 3)} AS gap_to_close, {r("a", 3)} AS revenue_base_change, {r("b", 3)} AS transfer_change,
  {r("c", 3)} AS expenditure_change, {r("deficit", 3)} AS deficit, {r("normalization_gap", 3)} AS normalization_gap FROM closed""",
)
def closing_scenarios(spark, sf):
    out = bg.closing_scenarios(_result(spark, sf).withColumn("deficit_base", F.lit(None).cast("double")))
    money = ("gap_to_close", "revenue_base_change", "transfer_change", "expenditure_change", "deficit", "normalization_gap")
    return rounded(out.select(*KEY, "scenario", *money), 3, *money)


@query(
    "gap_structure",
    f"""WITH {BASE_SQL} SELECT municipality_name, year, {r("normalization_gap", 3)} AS normalization_gap,
  {r("least(structural_gap, normalization_gap)", 3)} AS structural_overlap,
  {r("greatest(normalization_gap - least(structural_gap, normalization_gap), 0)", 3)} AS non_structural_remainder,
  {r("normalization_gap / (1 + deficit_limit_ratio)", 3)} AS revenue_base_to_close, {r("normalization_gap", 3)} AS transfers_to_close,
  {r("normalization_gap", 3)} AS expenditure_cut_to_close, {r("normalization_gap", 3)} AS exception_to_close FROM result""",
)
def gap_structure(spark, sf):
    cols = (
        "normalization_gap",
        "structural_overlap",
        "non_structural_remainder",
        "revenue_base_to_close",
        "transfers_to_close",
        "expenditure_cut_to_close",
        "exception_to_close",
    )
    return rounded(bg.gap_structure(_result(spark, sf)).select(*KEY, *cols), 3, *cols)


@query(
    "budget_components",
    f"WITH {BASE_SQL} "
    + " UNION ALL ".join(
        f"SELECT municipality_name, year, '{label}' AS component, {r(c, 3)} AS value FROM result" for label, c in bg.COMPONENTS
    ),
)
def budget_components(spark, sf):
    return rounded(bg.components(_result(spark, sf)), 3, "value")


_GROUPS_SQL = f"""grouped AS (SELECT municipality_name, year, budget_side, grp, {data.money_sql("amount")} AS amount FROM lines GROUP BY 1, 2, 3, 4),
shares AS (SELECT *, coalesce(amount / nullif(sum(amount) OVER (PARTITION BY municipality_name, year, budget_side), 0), 0) AS share FROM grouped)"""


@query(
    "group_structure",
    f"""WITH {data.BUDGET_LINES_SQL}, {_GROUPS_SQL}
SELECT municipality_name, year, budget_side, grp AS "group", {r("amount", 2)} AS amount, {r("share", 9)} AS share FROM shares""",
)
def group_structure(spark, sf):
    return rounded(rounded(bg.group_structure(_lines(spark, sf)), 2, "amount"), 9, "share")


@query(
    "gap_exposure",
    f"""WITH {BASE_SQL}, {_GROUPS_SQL}
SELECT municipality_name, year, grp AS "group", {r("amount", 2)} AS amount, {r("share", 9)} AS share, {r("normalization_gap", 3)} AS normalization_gap,
  {r("share * normalization_gap", 3)} AS gap_exposure
FROM shares JOIN (SELECT municipality_name, year, normalization_gap FROM result) USING (municipality_name, year) WHERE budget_side = 'EXPENDITURE'""",
)
def gap_exposure(spark, sf):
    lines = bg.compact_lines(_lines(spark, sf))
    out = bg.gap_exposure(lines, _result(spark, sf, lines))
    return rounded(rounded(rounded(out, 2, "amount"), 9, "share"), 3, "normalization_gap", "gap_exposure")


@query(
    "flexible_cut",
    f"""WITH {BASE_SQL}, g AS (SELECT municipality_name, year, grp, {data.money_sql("amount")} AS amount,
  sum(amount * CASE flexibility WHEN 'PARTIAL' THEN 0.5 WHEN 'FLEXIBLE' THEN 1.0 ELSE 0.0 END) AS capacity
  FROM lines WHERE budget_side = 'EXPENDITURE' GROUP BY 1, 2, 3),
t AS (SELECT *, sum(capacity) OVER (PARTITION BY municipality_name, year) AS total FROM g)
SELECT municipality_name, year, grp AS "group", {r("amount", 2)} AS amount, {r("capacity", 3)} AS capacity,
  {r("CASE WHEN total > 0 THEN capacity / total * least(normalization_gap, total) ELSE 0 END", 3)} AS mechanical_cut,
  {r("greatest(normalization_gap - greatest(total, 0), 0)", 3)} AS remaining_gap
FROM t JOIN (SELECT municipality_name, year, normalization_gap FROM result) USING (municipality_name, year)""",
)
def flexible_cut(spark, sf):
    lines = bg.compact_lines(_lines(spark, sf))
    out = bg.flexible_cut(lines, _result(spark, sf, lines))
    return rounded(rounded(out, 2, "amount"), 3, "capacity", "mechanical_cut", "remaining_gap")


@query(
    "top_expenditure_groups",
    f"""WITH {data.BUDGET_LINES_SQL}, {_GROUPS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY municipality_name, year ORDER BY amount DESC, grp) AS k FROM shares WHERE budget_side = 'EXPENDITURE')
SELECT municipality_name, year, grp AS "group", {r("amount", 2)} AS amount, CAST(k AS INTEGER) AS rank FROM ranked WHERE k <= 3""",
)
def top_expenditure_groups(spark, sf):
    out = bg.top_groups(_lines(spark, sf), n=3)
    return rounded(out.drop("share", "budget_side"), 2, "amount")


@query(
    "plan_arithmetic",
    f"""WITH {BASE_SQL} SELECT municipality_name, year, {r("expenditure - total_revenue", 2)} AS calculated_deficit,
  {r("greatest(expenditure - total_revenue - financing_sources, 0)", 2)} AS uncovered_plan_need FROM result""",
)
def plan_arithmetic(spark, sf):
    out = bg.plan_arithmetic(_result(spark, sf)).select(*KEY, "calculated_deficit", "uncovered_plan_need")
    return rounded(out, 2, "calculated_deficit", "uncovered_plan_need")
