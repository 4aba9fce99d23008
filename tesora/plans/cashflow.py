"""Queries on cash lines, vintages, corrections and normalised months."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesora.operators import cash as cs
from tesora.operators.temporal import ytd_to_flow
from tesora.plans import inputs as data
from tesora.plans.registry import query, rounded, sql_round as r

AS_OF = data.CASH_AS_OF

_DECIDED_SQL = f"""{data.CASH_TOTALS_SQL}, {data.CORRECTIONS_SQL},
seen AS (SELECT * FROM cash0 WHERE CAST(month + INTERVAL 40 DAY AS DATE) <= DATE '{AS_OF}'),
months0 AS (SELECT DISTINCT municipality, month FROM seen),
due AS (SELECT * FROM corr WHERE approved_at <= DATE '{AS_OF}'),
formal AS (SELECT *, CASE WHEN reason = '' THEN 'MISSING_REASON' WHEN amount <= 0 THEN 'BAD_AMOUNT' END AS formal_problem FROM due),
ok AS (SELECT * FROM formal WHERE formal_problem IS NULL),
weighed AS (SELECT ok.*, count(*) OVER (PARTITION BY ok.municipality, correction_id) AS id_rows,
  sum(ok.amount) OVER (PARTITION BY ok.municipality, cash_month, ok.kbk, ok.side, kind) AS allocated,
  sum(CASE WHEN kind <> 'REFUND_REALLOCATION' THEN ok.amount END) OVER (PARTITION BY ok.municipality, cash_month, ok.kbk, ok.side) AS excluded,
  coalesce(seen.amount, 0) AS observed, m1.month IS NOT NULL AS cash_seen, m2.month IS NOT NULL AS target_seen
  FROM ok LEFT JOIN seen ON seen.municipality = ok.municipality AND seen.month = cash_month AND seen.kbk = ok.kbk AND seen.side = ok.side
  LEFT JOIN months0 m1 ON m1.municipality = ok.municipality AND m1.month = cash_month
  LEFT JOIN months0 m2 ON m2.municipality = ok.municipality AND m2.month = target_month),
decided AS (SELECT correction_id, kind, municipality, kbk, side, cash_month, amount, target_month, CASE
  WHEN id_rows > 1 THEN 'REPEATED_ID' WHEN NOT cash_seen THEN 'MONTH_NOT_OBSERVED'
  WHEN kind <> 'REFUND_REALLOCATION' AND excluded > observed THEN 'EXCLUSIONS_ABOVE_LINE'
  WHEN kind = 'REFUND_REALLOCATION' AND (observed >= 0 OR side <> 'REVENUE' OR allocated > -observed) THEN 'REFUND_NOT_SUPPORTED'
  WHEN kind = 'REFUND_REALLOCATION' AND (target_month IS NULL OR target_month >= cash_month) THEN 'REFUND_TARGET'
  WHEN kind = 'ADVANCE_REALLOCATION' AND (side <> 'REVENUE' OR observed < allocated) THEN 'ADVANCE_NOT_SUPPORTED'
  WHEN kind = 'ADVANCE_REALLOCATION' AND (target_month IS NULL OR target_month <= cash_month) THEN 'ADVANCE_TARGET'
  WHEN kind IN ('ONE_OFF', 'CARRYOVER') AND observed < allocated THEN 'EXCLUSION_ABOVE_LINE'
  WHEN kind = 'CARRYOVER' AND side <> 'FINANCING' THEN 'CARRYOVER_SIDE'
  WHEN kind IN ('ONE_OFF', 'CARRYOVER') AND target_month IS NOT NULL THEN 'EXCLUSION_WITH_TARGET'
  WHEN target_month IS NOT NULL AND NOT target_seen THEN 'TARGET_NOT_OBSERVED' END AS reason_code FROM weighed
  UNION ALL SELECT correction_id, kind, municipality, kbk, side, cash_month, amount, target_month, formal_problem FROM formal WHERE formal_problem IS NOT NULL),
effects AS (SELECT municipality, correction_id, kind, kbk, side, cash_month AS month,
    CASE WHEN kind = 'REFUND_REALLOCATION' THEN amount ELSE -amount END AS delta, false AS is_target FROM decided WHERE reason_code IS NULL
  UNION ALL SELECT municipality, correction_id, kind, kbk, side, target_month, CASE WHEN kind = 'REFUND_REALLOCATION' THEN -amount ELSE amount END, true
  FROM decided WHERE reason_code IS NULL AND target_month IS NOT NULL)"""

_MONTHS_SQL = f"""{_DECIDED_SQL},
raw AS (SELECT municipality, month, coalesce(sum(amount) FILTER (side = 'REVENUE'), 0) AS raw_revenue,
  coalesce(sum(amount) FILTER (side = 'EXPENDITURE'), 0) AS raw_expenditure, coalesce(sum(amount) FILTER (side = 'FINANCING'), 0) AS raw_financing
  FROM seen GROUP BY 1, 2),
eff AS (SELECT municipality, month, coalesce(sum(delta) FILTER (side = 'REVENUE'), 0) AS dr, coalesce(sum(delta) FILTER (side = 'EXPENDITURE'), 0) AS de,
  coalesce(sum(delta) FILTER (side = 'FINANCING'), 0) AS df, coalesce(-sum(delta) FILTER (kind = 'CARRYOVER'), 0) AS carry FROM effects GROUP BY 1, 2),
joined AS (SELECT raw.*, coalesce(dr, 0) AS dr, coalesce(de, 0) AS de, coalesce(df, 0) AS df, coalesce(carry, 0) AS carry,
  1 + 0.0625 * (year(month) - 1995) AS deflator, n_nationkey * 1000000.0 AS opening
  FROM raw LEFT JOIN eff USING (municipality, month) JOIN nation ON municipality = n_name),
codes AS (SELECT municipality, month, kbk, side, coalesce(amount, 0) + coalesce(delta, 0) AS value,
  CASE WHEN kbk = 'KF' AND month(month) = 11 THEN NULL WHEN kbk = 'KO' THEN 1.25 WHEN kbk = 'KF' THEN 0.5 ELSE 1.0 END AS factor
  FROM (SELECT municipality, month, kbk, side, amount FROM seen) FULL JOIN
       (SELECT municipality, month, kbk, side, sum(delta) AS delta FROM effects GROUP BY 1, 2, 3, 4) USING (municipality, month, kbk, side)
  WHERE side <> 'FINANCING'),
season AS (SELECT municipality, month, sum(value / factor * CASE WHEN side = 'REVENUE' THEN 1 ELSE -1 END) AS seasonal, count(*) FILTER (factor IS NULL) AS gaps
  FROM codes GROUP BY 1, 2),
months AS (SELECT municipality, month, raw_revenue, raw_expenditure, raw_financing, raw_revenue + dr AS normalized_revenue,
  raw_expenditure + de AS normalized_expenditure, raw_revenue + dr - raw_expenditure - de AS recurring_balance,
  opening + sum(raw_revenue + raw_financing - carry - raw_expenditure) OVER (PARTITION BY municipality ORDER BY month) AS cash_balance,
  (raw_revenue + dr - raw_expenditure - de) / deflator AS real_recurring_balance,
  CASE WHEN coalesce(gaps, 0) = 0 THEN coalesce(seasonal, 0) END AS seasonal_balance,
  CASE WHEN dr <> 0 OR de <> 0 OR df <> 0 THEN 'ADJUSTED' ELSE 'OBSERVED' END AS status
  FROM joined LEFT JOIN season USING (municipality, month))"""


def _months(spark, sf):
    lines = data.cash_lines(spark, sf)
    calendar = lines.select("month").distinct()
    deflators = calendar.withColumn("deflator", 1 + 0.0625 * (F.year("month") - 1995))
    factor = F.when(F.col("kbk") == "KO", 1.25).when(F.col("kbk") == "KF", 0.5).otherwise(1.0)
    codes = F.explode(F.array(F.lit("KO"), F.lit("KF"), F.lit("RET"))).alias("kbk")
    factors = (
        calendar.select("month", codes)
        .where(~((F.col("kbk") == "KF") & (F.month("month") == 11)))
        .withColumn("factor", factor)
    )
    opening = data.read(spark, sf, "nation").select(
        F.col("n_name").alias("municipality"), (F.col("n_nationkey") * 1000000.0).alias("opening_balance")
    )
    return cs.normalize_months(
        lines,
        data.corrections(spark, sf),
        as_of=AS_OF,
        source="UFK_CASH",
        deflators=deflators,
        season_factors=factors,
        opening=opening,
    )


_MONEY = ("raw_revenue", "raw_expenditure", "raw_financing", "normalized_revenue", "normalized_expenditure", "recurring_balance", "cash_balance")


@query(
    "cash_months",
    f"""WITH {_MONTHS_SQL} SELECT municipality, month, {', '.join(f'{r(c, 4)} AS {c}' for c in _MONEY)}, {r("greatest(-cash_balance, 0)", 4)} AS reserve_need,
  {r("real_recurring_balance", 4)} AS real_recurring_balance, {r("seasonal_balance", 4)} AS seasonal_balance, status FROM months""",
)
def cash_months(spark, sf):
    return rounded(
        _months(spark, sf).months, 4, *_MONEY, "reserve_need", "seasonal_balance", "real_recurring_balance"
    )


@query("correction_effects", f"WITH {_DECIDED_SQL} SELECT municipality, correction_id, kind, kbk, side, month, {r('delta', 4)} AS delta, is_target FROM effects")
def correction_effects(spark, sf):
    return rounded(_months(spark, sf).applied, 4, "delta")


@query(
    "correction_decisions",
    f"WITH {_DECIDED_SQL} SELECT correction_id, municipality, cash_month, kind, {r('amount', 4)} AS amount, reason_code FROM decided WHERE reason_code IS NOT NULL",
)
def correction_decisions(spark, sf):
    bad = _months(spark, sf).rejected_corrections
    return rounded(bad.select("correction_id", "municipality", "cash_month", "kind", "amount", "reason_code"), 4, "amount")


@query(
    "cash_against_plan",
    f"""WITH {_MONTHS_SQL}, plan AS (SELECT municipality, CAST(month + INTERVAL 12 MONTH AS DATE) AS month,
  sum(amount) FILTER (side = 'REVENUE' AND kbk <> 'RET') AS planned_revenue, sum(amount) FILTER (side = 'EXPENDITURE') AS planned_expenditure FROM cash0 GROUP BY 1, 2)
SELECT municipality, month, {r("raw_revenue / nullif(planned_revenue, 0)", 8)} AS raw_revenue_execution_rate,
  {r("raw_expenditure / nullif(planned_expenditure, 0)", 8)} AS raw_expenditure_execution_rate,
  {r("(normalized_revenue - planned_revenue) / nullif(planned_revenue, 0)", 8)} AS normalized_revenue_gap,
  {r("(normalized_expenditure - planned_expenditure) / nullif(planned_expenditure, 0)", 8)} AS normalized_expenditure_gap,
  {r("greatest(-cash_balance, 0)", 4)} AS cash_reserve_need, {r("recurring_balance", 4)} AS recurring_balance, 'ANALYTICAL_MONTHLY' AS basis
FROM months JOIN plan USING (municipality, month) WHERE planned_revenue >= 0 AND planned_expenditure >= 0""",
)
def cash_against_plan(spark, sf):
    plan = (
        data.cash_totals(spark, sf)
        .groupBy("municipality", F.add_months("month", 12).alias("month"))
        .agg(
            F.sum(F.when((F.col("side") == "REVENUE") & (F.col("kbk") != "RET"), F.col("amount"))).alias("planned_revenue"),
            F.sum(F.when(F.col("side") == "EXPENDITURE", F.col("amount"))).alias("planned_expenditure"),
        )
    )
    out = cs.against_plan(_months(spark, sf).months, plan)
    out = rounded(out, 4, "cash_reserve_need", "recurring_balance")
    return rounded(
        out,
        8,
        "raw_revenue_execution_rate",
        "raw_expenditure_execution_rate",
        "normalized_revenue_gap",
        "normalized_expenditure_gap",
    )


@query(
    "revenue_bridge",
    f"""WITH {_DECIDED_SQL} SELECT municipality, month, CASE WHEN is_target THEN 'Отнесено к месяцу' WHEN kind = 'REFUND_REALLOCATION' THEN 'Перенос возврата'
  WHEN kind = 'ADVANCE_REALLOCATION' THEN 'Перенос аванса' ELSE 'Разовое поступление' END || ' · ' || correction_id AS step, {r("delta", 4)} AS delta
FROM effects WHERE side = 'REVENUE'""",
)
def revenue_bridge(spark, sf):
    return rounded(cs.revenue_bridge(_months(spark, sf))[0], 4, "delta")


@query("revenue_bridge_check", f"WITH {_MONTHS_SQL} SELECT municipality, month, true AS balanced FROM months")
def revenue_bridge_check(spark, sf):
    return cs.revenue_bridge(_months(spark, sf))[1]


@query(
    "cash_side_totals",
    f"""WITH {data.CASH_TOTALS_SQL} SELECT municipality, month, {r("coalesce(sum(amount) FILTER (side = 'REVENUE'), 0)", 2)} AS raw_revenue,
  {r("coalesce(sum(amount) FILTER (side = 'EXPENDITURE'), 0)", 2)} AS raw_expenditure, {r("coalesce(sum(amount) FILTER (side = 'FINANCING'), 0)", 2)} AS raw_financing
FROM cash0 GROUP BY 1, 2""",
)
def cash_side_totals(spark, sf):
    return rounded(cs.side_totals(data.cash_lines(spark, sf)), 2, "raw_revenue", "raw_expenditure", "raw_financing")


@query(
    "cash_line_contract",
    """SELECT CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'UNKNOWN_SIDE' WHEN l_tax > 0.07 THEN 'BAD_PRELIMINARY'
  WHEN l_tax < 0.005 THEN 'STATUS_CONFLICT' WHEN l_quantity > 45 THEN 'BAD_KVR' WHEN day(l_shipdate) <> 1 THEN 'NOT_A_MONTH' ELSE 'clean' END AS verdict, count(*) AS n_lines
FROM lineitem GROUP BY 1""",
)
def cash_line_contract(spark, sf):
    items = data.read(spark, sf, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", "REVENUE").when(F.col("l_returnflag") == "A", "EXPENDITURE")
    raw = items.select(
        F.lit("m").alias("municipality"),
        F.col("l_shipdate").cast("date").cast("string").alias("month"),
        F.lit("k").alias("kbk"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "OTHER").otherwise(F.coalesce(side, F.lit("FINANCING"))).alias("side"),
        F.translate(F.col("l_extendedprice").cast("string"), ".", ",").alias("amount"),
        F.lit("UFK_CASH").alias("source"),
        F.lit("2002-01-01").alias("available_at"),
        F.lit("doc").alias("source_document"),
        F.lit("MONTH").alias("period_basis"),
        F.when(F.col("l_tax") > 0.07, "maybe").otherwise(" True").alias("preliminary"),
        F.when(F.col("l_tax") < 0.005, "final").otherwise("").alias("preliminary_status"),
        F.when(F.col("l_quantity") > 45, "12a").otherwise("244").alias("kvr"),
    )
    verdict = F.coalesce("reason_code", F.lit("clean")).alias("verdict")
    return cs.check_lines(raw).marked.groupBy(verdict).agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "correction_contract",
    f"""WITH {data.CASH_TOTALS_SQL}, {data.CORRECTIONS_SQL}
SELECT CASE WHEN reason = '' THEN 'MISSING_REASON' WHEN amount <= 0 THEN 'BAD_AMOUNT' WHEN month(cash_month) = 4 THEN 'APPROVED_BEFORE_MONTH' ELSE 'clean' END AS verdict, count(*) AS n_corrections
FROM corr GROUP BY 1""",
)
def correction_contract(spark, sf):
    rows = data.corrections(spark, sf)
    early = F.when(F.month("cash_month") == 4, F.date_sub("cash_month", 1)).otherwise(F.col("approved_at"))
    verdict = F.coalesce("reason_code", F.lit("clean")).alias("verdict")
    return cs.check_corrections(rows.withColumn("approved_at", early)).marked.groupBy(verdict).agg(F.count(F.lit(1)).alias("n_corrections"))


@query(
    "latest_vintage",
    f"""WITH n AS (SELECT l_orderkey, l_linenumber, l_shipdate, count(*) AS n, any_value(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC) AS v FROM n)
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS available_at, price FROM k WHERE v = 1 AND n = 1""",
)
def latest_vintage(spark, sf):
    items = data.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("available_at"), F.col("l_extendedprice").alias("price")
    )
    return cs.latest_vintage(items, keys=["l_orderkey", "l_linenumber"]).clean


@query(
    "repeated_vintages",
    """WITH n AS (SELECT l_orderkey, l_linenumber, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC) AS v FROM n)
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS available_at, n AS n_rows, 'REPEATED_VINTAGE' AS reason_code FROM k WHERE v = 1 AND n > 1""",
)
def repeated_vintages(spark, sf):
    items = data.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("available_at"), F.col("l_extendedprice").alias("price")
    )
    return cs.latest_vintage(items, keys=["l_orderkey", "l_linenumber"]).quarantine


_FLOWS_SQL = f"""{data.REPORT_LINES_SQL},
vis AS (SELECT * FROM report WHERE available_at <= DATE '2001-10-15'),
lat AS (SELECT *, row_number() OVER (PARTITION BY municipality, month, kbk, side ORDER BY available_at DESC) AS v FROM vis),
chain AS (SELECT *, lag(month(month)) OVER c AS pm, lag(amount) OVER c AS pa FROM lat WHERE v = 1
  WINDOW c AS (PARTITION BY municipality, kbk, side, year(month) ORDER BY month)),
flagged AS (SELECT *, bool_or(month(month) <> coalesce(pm, 0) + 1) OVER (PARTITION BY municipality, kbk, side, year(month)) AS broken FROM chain)"""


@query(
    "monthly_from_ytd",
    f"""WITH {_FLOWS_SQL} SELECT municipality, month, kbk, side, {r("amount - coalesce(pa, 0)", 3)} AS amount, available_at, 'MONTH' AS period_basis
FROM flagged WHERE NOT broken""",
)
def monthly_from_ytd(spark, sf):
    lines = cs.visible_lines(data.report_lines(spark, sf), "2001-10-15")
    flows = cs.monthly_from_ytd(lines).clean
    return rounded(flows.select("municipality", "month", "kbk", "side", "amount", "available_at", "period_basis"), 3, "amount")


@query(
    "broken_ytd_chains",
    f"WITH {_FLOWS_SQL} SELECT municipality, month, kbk, side, 'BROKEN_YTD_CHAIN' AS reason_code FROM flagged WHERE broken",
)
def broken_ytd_chains(spark, sf):
    lines = cs.visible_lines(data.report_lines(spark, sf), "2001-10-15")
    return cs.monthly_from_ytd(lines).quarantine.select("municipality", "month", "kbk", "side", "reason_code")


@query(
    "ytd_to_flow",
    f"""WITH {data.REPORT_LINES_SQL}, s AS (SELECT municipality AS municipality_id, kbk || '-' || side AS indicator,
  CASE WHEN month(month) >= 10 THEN 'v2' ELSE 'v1' END AS classification_version, last_day(month) AS period_end, total AS value FROM ytd)
SELECT municipality_id, indicator, period_end, classification_version, value,
  {r("CASE WHEN year(lag(period_end) OVER w) = year(period_end) AND lag(classification_version) OVER w = classification_version THEN value - lag(value) OVER w END", 2)} AS flow_derived,
  CASE WHEN year(lag(period_end) OVER w) IS DISTINCT FROM year(period_end) THEN 'no_prior_snapshot'
       WHEN lag(classification_version) OVER w = classification_version THEN 'derived' ELSE 'incompatible_snapshot' END AS flow_derivation_status
FROM s WINDOW w AS (PARTITION BY municipality_id, indicator ORDER BY period_end)""",
)
def ytd_to_flow_query(spark, sf):
    final = data.report_lines(spark, sf).where(F.col("available_at") == F.date_add("month", 75))
    snapshots = final.select(
        F.col("municipality").alias("municipality_id"),
        F.concat_ws("-", "kbk", "side").alias("indicator"),
        F.lit("m1").alias("method_version"),
        F.when(F.month("month") >= 10, "v2").otherwise("v1").alias("classification_version"),
        F.lit("all").alias("scope"),
        F.lit("rub").alias("unit"),
        F.last_day("month").alias("period_end"),
        F.col("amount").alias("value"),
    )
    out = ytd_to_flow(snapshots).drop("method_version", "scope", "unit")
    return rounded(out, 2, "flow_derived")
