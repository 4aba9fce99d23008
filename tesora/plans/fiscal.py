"""Queries on the annual fiscal panel, peers, flags, indicators and source agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesora.functions import scalar as S
from tesora.operators import fiscal as fs
from tesora.operators import reconcile as rc
from tesora.plans import inputs as data
from tesora.plans.registry import query, rounded, sql_round as r

KEY = ["year", "municipality_name"]

PANEL_SQL = f"""{data.FISCAL_CORE_SQL}, {data.RANKINGS_SQL},
fpanel AS (SELECT year, municipality_name, '' AS municipality_oktmo, make_date(year, 12, 31) AS period_end, 'YEAR' AS frequency,
  (tax_actual + nontax_actual - (tax_initial + nontax_initial)) / nullif(tax_initial + nontax_initial, 0) AS income_plan_deviation,
  program_expense / nullif(total_expense, 0) AS program_expense_share, budget_amendments, municipal_debt / nullif(own_revenue_base, 0) AS debt_load,
  quality_rank, article136_high_subsidy_flag, coalesce(source_file, '') AS source_file, 'derived_from_active_or_official_public' AS data_status
  FROM core LEFT JOIN rankings USING (year, municipality_name) WHERE ingest_seq = 2)"""


def _panel(spark, sf):
    return fs.fiscal_panel(data.fiscal_core(spark, sf), data.rankings(spark, sf))


@query(
    "fiscal_panel",
    f"""WITH {PANEL_SQL} SELECT * REPLACE ({r("income_plan_deviation", 9)} AS income_plan_deviation, {r("program_expense_share", 9)} AS program_expense_share,
  {r("debt_load", 9)} AS debt_load) FROM fpanel""",
)
def fiscal_panel(spark, sf):
    return rounded(_panel(spark, sf), 9, "income_plan_deviation", "program_expense_share", "debt_load")


_FLAGS_SQL = f"""{PANEL_SQL},
pct AS (SELECT a.*, CASE WHEN a.debt_load IS NOT NULL THEN (SELECT count(*) FILTER (b.debt_load <= a.debt_load) / count(b.debt_load) FROM fpanel b WHERE b.year = a.year) END AS debt_pct,
  (SELECT count(*) FILTER (b.budget_amendments <= a.budget_amendments) / count(b.budget_amendments) FROM fpanel b WHERE b.year = a.year) AS amend_pct,
  CASE WHEN a.quality_rank IS NOT NULL THEN (SELECT count(*) FILTER (b.quality_rank <= a.quality_rank) / count(b.quality_rank) FROM fpanel b WHERE b.year = a.year) END AS rank_pct
  FROM fpanel a),
flags AS (
  SELECT year, municipality_name, 'income_shortfall' AS code, 1 AS i, 'Доходы ниже первоначального плана' AS title, coalesce(income_plan_deviation < 0, false) AS active FROM pct
  UNION ALL SELECT year, municipality_name, 'debt_peer_high', 2, 'Повышенная долговая нагрузка относительно peers', coalesce(debt_pct >= 0.75 AND debt_load > 0, false) FROM pct
  UNION ALL SELECT year, municipality_name, 'amendments_peer_high', 3, 'Высокая частота изменений бюджета относительно peers', coalesce(amend_pct >= 0.75, false) FROM pct
  UNION ALL SELECT year, municipality_name, 'quality_rank_peer', 4, 'Контекстный флаг официального ранга', coalesce(rank_pct >= 0.75, false) FROM pct)"""


@query("peer_flags", f"WITH {_FLAGS_SQL} SELECT year, municipality_name, code, title, active FROM flags")
def peer_flags(spark, sf):
    return fs.screening_flags(_panel(spark, sf)).drop("explanation")


@query(
    "screening_conclusions",
    f"""WITH {_FLAGS_SQL}, s AS (SELECT year, municipality_name, CAST(count(*) FILTER (active) AS INTEGER) AS active_flags,
  coalesce(string_agg(title, '; ' ORDER BY i) FILTER (active), '') AS titles FROM flags GROUP BY 1, 2)
SELECT *, CASE WHEN active_flags = 0 THEN 'По доступным Reference-признакам скрининговых флагов не выявлено. Это не означает состояние NORMAL: для него нужны временная устойчивость, калиброванный порог и подтверждение детекторами.'
  ELSE 'Есть ' || active_flags || ' скрининговых флаг(а): ' || titles || '. Это повод для наблюдения, но не подтвержденный структурный шок. Для WARNING/BREAK_CONFIRMED нужны persistence и независимое подтверждение.' END AS conclusion
FROM s""",
)
def screening_conclusions(spark, sf):
    return fs.screening_conclusion(fs.screening_flags(_panel(spark, sf)))


@query(
    "domain_assessments",
    f"""WITH {_FLAGS_SQL}, s AS (SELECT year, municipality_name, count(*) FILTER (active) AS n, count(*) FILTER (active AND i <= 3) AS strong FROM flags GROUP BY 1, 2)
SELECT year, municipality_name, domain, CASE WHEN domain <> 'Municipal Finance' THEN 'NO_DATA' WHEN n > 0 THEN 'SCREENING_SIGNAL' ELSE 'CONTEXT' END AS status,
  CASE WHEN domain <> 'Municipal Finance' THEN 'INSUFFICIENT' WHEN strong >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS evidence
FROM s, (VALUES ('Consumer Demand'), ('Income & Labour'), ('Cost of Living'), ('Business Activity'), ('Municipal Finance'), ('Economic Structure')) d(domain)""",
)
def domain_assessments(spark, sf):
    return fs.domain_assessments(fs.screening_flags(_panel(spark, sf)))


@query(
    "peer_percentiles",
    """SELECT s_suppkey, s_nationkey, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 9) AS balance_percentile FROM supplier""",
)
def peer_percentiles(spark, sf):
    df = data.read(spark, sf, "supplier")
    out = fs.peer_percentile(df, group=["s_nationkey"], value="s_acctbal", out="balance_percentile")
    return rounded(out.select("s_suppkey", "s_nationkey", "balance_percentile"), 9, "balance_percentile")


@query(
    "peer_debt_median",
    f"""WITH {PANEL_SQL} SELECT year, {r("median(debt_load)", 9)} AS median, count(debt_load) AS n FROM fpanel GROUP BY 1 HAVING count(debt_load) > 0""",
)
def peer_debt_median(spark, sf):
    return rounded(fs.peer_median(_panel(spark, sf), group=["year"], value="debt_load"), 9, "median")


@query(
    "balance_medians",
    f"""SELECT c_mktsegment, {r("median(c_acctbal)", 4)} AS median, count(*) AS n FROM customer GROUP BY 1""",
)
def balance_medians(spark, sf):
    return rounded(fs.peer_median(data.read(spark, sf, "customer"), group=["c_mktsegment"], value="c_acctbal"), 4, "median")


@query(
    "latest_fiscal_rows",
    f"""WITH {PANEL_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY municipality_name ORDER BY year DESC) AS v FROM fpanel)
SELECT municipality_name, year, budget_amendments, {r("debt_load", 9)} AS debt_load FROM k WHERE v = 1""",
)
def latest_fiscal_rows(spark, sf):
    out = fs.latest_row(_panel(spark, sf), entity=["municipality_name"], order="year")
    return rounded(out.select("municipality_name", "year", "budget_amendments", "debt_load"), 9, "debt_load")


@query(
    "latest_fiscal_values",
    f"""WITH {PANEL_SQL} SELECT municipality_name, arg_max(quality_rank, year) FILTER (quality_rank IS NOT NULL) AS quality_rank,
  {r("arg_max(income_plan_deviation, year) FILTER (income_plan_deviation IS NOT NULL)", 9)} AS income_plan_deviation FROM fpanel GROUP BY 1""",
)
def latest_fiscal_values(spark, sf):
    out = fs.latest_values(
        _panel(spark, sf), entity=["municipality_name"], order="year", columns=["quality_rank", "income_plan_deviation"]
    )
    return rounded(out, 9, "income_plan_deviation")


_INDICATORS = {
    "revision_rate": "(tax_actual - tax_initial) / nullif(tax_initial, 0)",
    "revision_magnitude": "abs(tax_actual - tax_initial) / nullif(abs(tax_initial), 0)",
    "execution_rate": "tax_actual / nullif(tax_initial, 0)",
    "execution_gap": "(tax_actual - tax_initial) / nullif(tax_initial, 0)",
    "coverage_gap": "own_revenue_base / nullif(total_expense, 0) - 1",
    "i13": "CASE WHEN tax_initial + nontax_initial <> 0 THEN greatest((tax_actual + nontax_actual - (tax_initial + nontax_initial)) / nullif(tax_initial + nontax_initial, 0), 0) END",
    "i15": "program_expense / nullif(total_expense, 0)",
    "i25": "nontax_actual / nullif((tax_initial + nontax_initial + tax_actual) / 3, 0)",
    "i26": "municipal_debt / nullif(total_expense, 0)",
    "i27": "nontax_initial / nullif(total_expense, 0)",
    "i33": "municipal_debt / nullif(own_revenue_base, 0)",
}


@query(
    "official_indicators",
    f"""WITH {data.FISCAL_CORE_SQL} SELECT year, municipality_name, ingest_seq, {', '.join(f"{r(e, 9)} AS {n}" for n, e in _INDICATORS.items())} FROM core""",
)
def official_indicators(spark, sf):
    df = data.fiscal_core(spark, sf).select(
        *KEY,
        "ingest_seq",
        S.revision_rate("tax_initial", "tax_actual").alias("revision_rate"),
        S.revision_magnitude("tax_initial", "tax_actual").alias("revision_magnitude"),
        S.execution_rate("tax_initial", "tax_actual").alias("execution_rate"),
        S.execution_gap("tax_initial", "tax_actual").alias("execution_gap"),
        S.coverage_gap("own_revenue_base", "total_expense").alias("coverage_gap"),
        S.i13("tax_initial", "nontax_initial", "tax_actual", "nontax_actual").alias("i13"),
        S.i15("program_expense", "total_expense").alias("i15"),
        S.i25("tax_initial", "nontax_initial", "tax_actual", "nontax_actual").alias("i25"),
        S.i26("municipal_debt", "total_expense").alias("i26"),
        S.i27("nontax_initial", "total_expense").alias("i27"),
        S.i33("municipal_debt", "own_revenue_base").alias("i33"),
    )
    return rounded(df, 9, *_INDICATORS)


@query(
    "reference_features",
    f"""WITH {data.FISCAL_CORE_SQL} SELECT year, municipality_name, ingest_seq, {r(_INDICATORS['revision_magnitude'], 9)} AS revision_magnitude,
  {r(_INDICATORS['execution_gap'], 9)} AS execution_gap, {r(_INDICATORS['coverage_gap'], 9)} AS coverage_gap, CAST(NULL AS DOUBLE) AS transfer_dependency,
  CAST(NULL AS DOUBLE) AS budget_provision_change, {r(_INDICATORS['i33'], 9)} AS debt_burden, CAST(NULL AS DOUBLE) AS article136_regime FROM core""",
)
def reference_features(spark, sf):
    df = data.fiscal_core(spark, sf).select(
        *KEY,
        "ingest_seq",
        F.round(S.revision_magnitude("tax_initial", "tax_actual"), 9).alias("revision_magnitude"),
        F.round(S.execution_gap("tax_initial", "tax_actual"), 9).alias("execution_gap"),
        F.round(S.coverage_gap("own_revenue_base", "total_expense"), 9).alias("coverage_gap"),
        F.round(S.i33("municipal_debt", "own_revenue_base"), 9).alias("debt_burden"),
    )
    return S.reference_features(df, [*KEY, "ingest_seq"])


@query(
    "plan_against_fact",
    f"""WITH {data.FISCAL_CORE_SQL}, c AS (SELECT * FROM core WHERE ingest_seq = 2)
SELECT p.municipality_name, p.year, {r("p.own_revenue_base", 2)} AS planned_revenue, {r("f.tax_actual + f.nontax_actual", 2)} AS fact_revenue,
  {r("(p.own_revenue_base / nullif(f.tax_actual + f.nontax_actual, 0) - 1) * 100", 7)} AS revenue_change_pct, {r("p.total_expense", 2)} AS planned_expenditure,
  {r("f.total_expense", 2)} AS fact_expenditure, {r("(p.total_expense / nullif(f.total_expense, 0) - 1) * 100", 7)} AS expenditure_change_pct
FROM c p JOIN c f ON p.municipality_name = f.municipality_name AND p.year = f.year + 1""",
)
def plan_against_fact(spark, sf):
    core = data.fiscal_core(spark, sf).where(F.col("ingest_seq") == 2)
    plan = core.select(*KEY, F.col("own_revenue_base").alias("revenue_base"), F.col("total_expense").alias("expenditure"))
    out = fs.plan_against_fact(plan, core)
    out = rounded(out, 2, "planned_revenue", "fact_revenue", "planned_expenditure", "fact_expenditure")
    return rounded(out, 7, "revenue_change_pct", "expenditure_change_pct")


# ---- two sources, two versions -----------------------------------------------


def _sources(spark, sf):
    ordered = (
        data.at_buyer(spark, sf, data.read(spark, sf, "orders"))
        .groupBy(F.col("n_name").alias("oktmo"), data.month("o_orderdate").alias("period"))
        .agg(data.money("o_totalprice").alias("value"))
    )
    shipped = (
        data.at_supplier(spark, sf, data.read(spark, sf, "lineitem"))
        .groupBy(F.col("n_name").alias("oktmo"), data.month("l_shipdate").alias("period"))
        .agg(data.money("l_extendedprice").alias("value"))
    )
    tag = lambda df: df.withColumns(
        {
            "available_at": F.date_add("period", 60),
            "frequency": F.lit("month"),
            "unit": F.lit("rub"),
            "measure": F.when(F.col("oktmo") == "NATION_7", F.lit("net")).otherwise("gross"),
        }
    )
    return tag(ordered), tag(shipped).withColumn("measure", F.lit("gross"))


@query(
    "reconcile_sources",
    f"""WITH a AS (SELECT n_name AS oktmo, {data.month_sql("o_orderdate")} AS period, {data.money_sql("o_totalprice")} AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
b AS (SELECT n_name AS oktmo, {data.month_sql("l_shipdate")} AS period, {data.money_sql("l_extendedprice")} AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
g AS (SELECT oktmo, count(*) AS n, corr(a.value, b.value) AS c FROM a JOIN b USING (oktmo, period)
  WHERE CAST(period + INTERVAL 60 DAY AS DATE) <= DATE '2001-06-30' GROUP BY 1)
SELECT oktmo, n, {r("CASE WHEN oktmo <> 'NATION_7' AND n >= 8 THEN c END", 8)} AS correlation,
  CASE WHEN oktmo = 'NATION_7' THEN 'not_comparable' WHEN n < 8 THEN 'insufficient' WHEN c >= 0.1 THEN 'consistent' ELSE 'inconsistent' END AS status FROM g""",
)
def reconcile_sources(spark, sf):
    left, right = _sources(spark, sf)
    return rounded(rc.reconcile(left, right, as_of="2001-06-30", threshold=0.1), 8, "correlation")


def _versions(spark, sf):
    before = data.read(spark, sf, "customer").where(F.col("c_acctbal") > -500).withColumn("seq", F.lit(1))
    after = data.read(spark, sf, "customer").where(F.col("c_acctbal") < 9500)
    after = after.withColumns(
        {
            "c_acctbal": F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 1.0).otherwise(F.col("c_acctbal")),
            "c_name": F.concat("c_name", F.lit(" ")),
            "seq": F.lit(1),
        }
    )
    old = after.where(F.col("c_mktsegment") == "MACHINERY").withColumns({"c_acctbal": F.lit(0.0), "seq": F.lit(0)})
    return before, after.unionByName(old)


_DIFF_SQL = """b AS (SELECT * FROM customer WHERE c_acctbal > -500), a AS (SELECT * FROM customer WHERE c_acctbal < 9500),
diff AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(a.c_nationkey, b.c_nationkey) AS c_nationkey,
  CASE WHEN b.c_custkey IS NULL THEN 'ADDED' WHEN a.c_custkey IS NULL THEN 'REMOVED' WHEN a.c_mktsegment = 'BUILDING' THEN 'CHANGED' ELSE 'SAME' END AS change
  FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)"""


@query("table_diff", f"WITH {_DIFF_SQL} SELECT c_custkey, c_nationkey, change FROM diff")
def table_diff(spark, sf):
    return rc.table_diff(*_versions(spark, sf), keys=["c_custkey", "c_nationkey"], seq="seq")


@query(
    "diff_summary",
    f"""WITH {_DIFF_SQL} SELECT count(*) FILTER (change = 'ADDED') AS added_keys, count(*) FILTER (change = 'REMOVED') AS removed_keys,
  count(*) FILTER (change = 'CHANGED') AS changed_keys, count(*) FILTER (change = 'SAME') AS same_keys FROM diff""",
)
def diff_summary(spark, sf):
    return rc.diff_summary(rc.table_diff(*_versions(spark, sf), keys=["c_custkey", "c_nationkey"], seq="seq"))


@query("affected_entities", f"WITH {_DIFF_SQL} SELECT DISTINCT c_nationkey FROM diff WHERE change <> 'SAME'")
def affected_entities(spark, sf):
    diff = rc.table_diff(*_versions(spark, sf), keys=["c_custkey", "c_nationkey"], seq="seq")
    return rc.affected_entities(diff, "c_nationkey")


@query(
    "keys_missing",
    "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def keys_missing(spark, sf):
    urgent = data.read(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return rc.keys_missing(data.read(spark, sf, "customer"), urgent.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query(
    "row_count_gate",
    """WITH b AS (SELECT o_orderpriority AS table_name, count(*) AS rows_before FROM orders GROUP BY 1),
a AS (SELECT o_orderpriority AS table_name, count(*) AS rows_after FROM orders
  WHERE (o_orderpriority <> '2-HIGH' OR o_orderstatus = 'O') AND o_orderpriority <> '5-LOW' AND o_totalprice > 10000 GROUP BY 1)
SELECT table_name, rows_before, coalesce(rows_after, 0) AS rows_after, coalesce(rows_after, 0) < rows_before * 0.8 AS rejected FROM b LEFT JOIN a USING (table_name)""",
)
def row_count_gate(spark, sf):
    orders = data.read(spark, sf, "orders")
    name = F.col("o_orderpriority").alias("table_name")
    kept = orders.where(
        ((F.col("o_orderpriority") != "2-HIGH") | (F.col("o_orderstatus") == "O"))
        & (F.col("o_orderpriority") != "5-LOW")
        & (F.col("o_totalprice") > 10000)
    )
    count = F.count(F.lit(1)).alias("rows")
    return rc.row_count_gate(orders.groupBy(name).agg(count), kept.groupBy(name).agg(count))
