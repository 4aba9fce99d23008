"""The domain tables, derived from the shared star schema; each next to its SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared schemas: no file is opened to find out its columns.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def money(c: Column | str) -> Column:
    """Exact sum of two-decimal amounts: whole cents add up the same in any order."""
    return F.sum(cents(c)) / 100.0


def cents(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * 100.0).cast("long")


def month(c: str) -> Column:
    return F.trunc(F.col(c).cast("date"), "MM")


def money_sql(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE)"


def month_sql(expr: str) -> str:
    return f"CAST(date_trunc('month', {expr}) AS DATE)"


# ---- monthly panel -----------------------------------------------------------


def panel(spark: SparkSession, sf: str, level: str) -> DataFrame:
    """Monthly order value per territory (region or nation) and priority."""
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    joined = at_buyer(spark, sf, orders)
    if level == "region":
        joined = joined.join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = "r_name" if level == "region" else "n_name"
    return joined.groupBy(
        F.col(name).alias("oktmo"), F.col("o_orderpriority").alias("category_code"), month("o_orderdate").alias("period_start")
    ).agg(money("o_totalprice").alias("spending_nominal"))


def panel_sql(level: str) -> str:
    name = "r_name" if level == "region" else "n_name"
    return f"""panel AS (
  SELECT {name} AS oktmo, o_orderpriority AS category_code, {month_sql("o_orderdate")} AS period_start,
         {money_sql("o_totalprice")} AS spending_nominal
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3)"""


def quantity_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly shipped quantity per supplier nation and return flag."""
    items = read(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_quantity")
    return (
        at_supplier(spark, sf, items)
        .groupBy(F.col("n_name").alias("oktmo"), F.col("l_returnflag").alias("category_code"), month("l_shipdate").alias("period_start"))
        .agg(money("l_quantity").alias("spending_nominal"))
    )


QUANTITY_PANEL_SQL = f"""qpanel AS (
  SELECT n_name AS oktmo, l_returnflag AS category_code, {month_sql("l_shipdate")} AS period_start,
         {money_sql("l_quantity")} AS spending_nominal
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3)"""


# Fact rows meet the key table first and the 25 nations after it: each join then has
# one side whose size the optimizer knows from its files, and it broadcasts only that.


def at_supplier(spark: SparkSession, sf: str, items: DataFrame) -> DataFrame:
    """Line items with the nation of their supplier."""
    supplier = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


def at_buyer(spark: SparkSession, sf: str, orders: DataFrame) -> DataFrame:
    """Orders with the nation of their customer."""
    customer = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


# ---- budget lines ------------------------------------------------------------


def budget_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One budget line per shipped item."""
    items = read(spark, sf, "lineitem")
    parts = read(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    side = (
        F.when(flag == "R", "REVENUE")
        .when((flag == "A") | (status == "F"), "EXPENDITURE")
        .when(F.col("l_tax") <= 0.02, "EXCEPTION")
        .otherwise("FINANCING")
    )
    size = F.col("p_size")
    flexibility = (
        F.when(size <= 12, "FIXED").when(size <= 25, "PARTIAL").when(size <= 40, "FLEXIBLE").otherwise("UNKNOWN")
    )
    joined = at_supplier(spark, sf, items.join(parts, F.col("l_partkey") == F.col("p_partkey")))
    return joined.select(
        F.year("l_shipdate").alias("year"),
        F.col("n_name").alias("municipality_name"),
        side.alias("budget_side"),
        F.col("p_type").alias("group"),
        F.col("p_name").alias("item_name"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("p_type") == "PROMO").alias("is_transfer"),
        (status == "O").alias("is_recurring"),
        (F.col("p_type") == "ECONOMY").alias("is_subvention"),
        (F.col("p_type") == "SMALL").alias("is_debt_service"),
        (F.col("l_discount") >= 0.05).alias("is_borrowing"),
        flexibility.alias("flexibility"),
    )


BUDGET_LINES_SQL = """lines AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, n_name AS municipality_name,
         CASE WHEN l_returnflag = 'R' THEN 'REVENUE' WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'EXPENDITURE'
              WHEN l_tax <= 0.02 THEN 'EXCEPTION' ELSE 'FINANCING' END AS budget_side,
         p_type AS grp, p_name AS item_name, l_extendedprice AS amount,
         p_type = 'PROMO' AS is_transfer, l_linestatus = 'O' AS is_recurring, p_type = 'ECONOMY' AS is_subvention,
         p_type = 'SMALL' AS is_debt_service, l_discount >= 0.05 AS is_borrowing,
         CASE WHEN p_size <= 12 THEN 'FIXED' WHEN p_size <= 25 THEN 'PARTIAL' WHEN p_size <= 40 THEN 'FLEXIBLE'
              ELSE 'UNKNOWN' END AS flexibility
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey)"""


# ---- cash --------------------------------------------------------------------


def cash_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly cash per nation, code and side; heavily discounted returns count as negative revenue."""
    items = at_supplier(spark, sf, read(spark, sf, "lineitem"))
    flag = F.col("l_returnflag")
    refund = (flag == "R") & (F.col("l_discount") >= 0.09)
    signed = F.when(refund, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return items.groupBy(
        F.col("n_name").alias("municipality"),
        month("l_shipdate").alias("month"),
        F.when(refund, "RET").otherwise(F.concat(F.lit("K"), F.col("l_linestatus"))).alias("kbk"),
        F.when(flag == "R", "REVENUE").when(flag == "A", "EXPENDITURE").otherwise("FINANCING").alias("side"),
    ).agg(money(signed).alias("amount"))


CASH_TOTALS_SQL = f"""cash0 AS (
  SELECT n_name AS municipality, {month_sql("l_shipdate")} AS month,
         CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 'RET' ELSE 'K' || l_linestatus END AS kbk,
         CASE WHEN l_returnflag = 'R' THEN 'REVENUE' WHEN l_returnflag = 'A' THEN 'EXPENDITURE' ELSE 'FINANCING' END AS side,
         {money_sql("CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN -l_extendedprice ELSE l_extendedprice END")} AS amount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3, 4)"""

CASH_AS_OF = "2001-06-30"


def cash_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Operational monthly lines, visible forty days after the month began."""
    return cash_totals(spark, sf).select(
        "municipality",
        "month",
        "kbk",
        "side",
        "amount",
        F.lit("UFK_CASH").alias("source"),
        F.date_add("month", 40).alias("available_at"),
        F.lit("register").alias("source_document"),
        F.lit("MONTH").alias("period_basis"),
        F.lit(True).alias("preliminary"),
    )


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Year-to-date report lines in two vintages; the first one is a tenth short."""
    from pyspark.sql import Window

    # at most twelve months per code and year
    ytd = Window.partitionBy("municipality", "kbk", "side", F.year("month")).orderBy("month").rowsBetween(
        Window.unboundedPreceding, 0
    )
    base = cash_totals(spark, sf).withColumn("total", F.sum(cents("amount")).over(ytd) / 100.0)
    vintages = F.array(
        F.struct((F.col("total") * 0.5).alias("amount"), F.date_add("month", 40).alias("available_at")),
        F.struct(F.col("total").alias("amount"), F.date_add("month", 75).alias("available_at")),
    )
    return base.select("municipality", "month", "kbk", "side", F.explode(vintages).alias("v")).select(
        "municipality",
        "month",
        "kbk",
        "side",
        "v.amount",
        F.lit("REPORT_0503117").alias("source"),
        "v.available_at",
        F.lit("form").alias("source_document"),
        F.lit("YTD").alias("period_basis"),
        F.lit(True).alias("preliminary"),
    )


REPORT_LINES_SQL = f"""{CASH_TOTALS_SQL}, ytd AS (
  SELECT *, CAST(sum(CAST(amount AS DECIMAL(20,2))) OVER (PARTITION BY municipality, kbk, side, year(month) ORDER BY month) AS DOUBLE) AS total
  FROM cash0), report AS (
  SELECT municipality, month, kbk, side, total * 0.5 AS amount, CAST(month + INTERVAL 40 DAY AS DATE) AS available_at FROM ytd
  UNION ALL SELECT municipality, month, kbk, side, total, CAST(month + INTERVAL 75 DAY AS DATE) FROM ytd)"""

# (kind, code, side, month of the year, share, target shift, id text, reason)
_CORRECTIONS = (
    ("REFUND_REALLOCATION", "RET", "REVENUE", None, -0.5, -1, "refund", "returned goods"),
    ("ADVANCE_REALLOCATION", "KO", "REVENUE", 12, 0.25, 1, "advance", "prepaid"),
    ("ONE_OFF", "KF", "REVENUE", 6, 0.25, None, "sale", "asset sale"),
    ("CARRYOVER", "KF", "FINANCING", 1, 0.5, None, "balance", "balance of the year before"),
    ("ONE_OFF", "KO", "EXPENDITURE", 3, 1.5, None, "too-much", "above the line"),
    ("ONE_OFF", "KF", "EXPENDITURE", 8, 0.25, None, "no-reason", ""),
    ("CARRYOVER", "KO", "REVENUE", 5, 0.25, None, "wrong-side", "balance booked as revenue"),
    ("ONE_OFF", "KO", "REVENUE", 7, 0.25, None, "repeated", "same id every year"),
)


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Eight families of corrections on the monthly cash, sound and unsound ones."""
    base = cash_totals(spark, sf)
    rows = []
    for kind, kbk, side, in_month, share, shift, tag, reason in _CORRECTIONS:
        hit = (F.col("kbk") == kbk) & (F.col("side") == side)
        if in_month is not None:
            hit = hit & (F.month("month") == in_month)
        ident = F.concat_ws("-", F.lit(tag), "municipality", *([] if tag == "repeated" else [F.col("month").cast("string")]))
        target = F.add_months("month", shift) if shift is not None else F.lit(None).cast("date")
        rows.append(
            F.when(
                hit,
                F.struct(
                    ident.alias("correction_id"),
                    F.lit(kind).alias("kind"),
                    (F.col("amount") * share).alias("fixed"),
                    F.lit(reason).alias("reason"),
                    target.alias("target_month"),
                ),
            )
        )
    spread = base.withColumn("c", F.explode(F.array_compact(F.array(*rows))))
    return spread.select(
        "c.correction_id",
        "c.kind",
        "municipality",
        "kbk",
        "side",
        F.col("month").alias("cash_month"),
        F.col("c.fixed").alias("amount"),
        "c.reason",
        F.lit("act").alias("evidence"),
        F.lit("office").alias("approved_by"),
        F.date_add("month", 45).alias("approved_at"),
        "c.target_month",
    )


def _corrections_sql() -> str:
    parts = []
    for kind, kbk, side, in_month, share, shift, tag, reason in _CORRECTIONS:
        ident = f"'{tag}-' || municipality" + ("" if tag == "repeated" else " || '-' || CAST(month AS VARCHAR)")
        target = "CAST(NULL AS DATE)" if shift is None else f"CAST(month + INTERVAL ({shift}) MONTH AS DATE)"
        where = f"kbk = '{kbk}' AND side = '{side}'" + (f" AND month(month) = {in_month}" if in_month else "")
        parts.append(
            f"SELECT {ident} AS correction_id, '{kind}' AS kind, municipality, kbk, side, month AS cash_month, "
            f"amount * {share}::DOUBLE AS amount, '{reason}' AS reason, CAST(month + INTERVAL 45 DAY AS DATE) AS approved_at, "
            f"{target} AS target_month FROM cash0 WHERE {where}"
        )
    return "corr AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


CORRECTIONS_SQL = _corrections_sql()


# ---- fiscal core -------------------------------------------------------------


def fiscal_core(spark: SparkSession, sf: str) -> DataFrame:
    """Annual amounts per nation in two vintages, and per region under a digit-only name."""
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    joined = at_buyer(spark, sf, orders)
    price = F.col("o_totalprice")
    small = F.when(price < 200000, price)

    def amounts(value: Column) -> list[Column]:
        pick = lambda cond: F.coalesce(money(F.when(cond, value)), F.lit(0.0))
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        return [
            pick(status == "F").alias("tax_initial"),
            pick(status == "P").alias("nontax_initial"),
            pick(priority.isin("1-URGENT", "2-HIGH")).alias("tax_actual"),
            pick(priority == "3-MEDIUM").alias("nontax_actual"),
            pick(priority == "5-LOW").alias("program_expense"),
            pick(priority.isin("4-NOT SPECIFIED", "5-LOW")).alias("total_expense"),
            F.count_if((status == "P") & value.isNotNull()).cast("double").alias("budget_amendments"),
            pick((status == "P") & (priority == "5-LOW")).alias("municipal_debt"),
            pick(priority.isin("1-URGENT", "2-HIGH", "3-MEDIUM")).alias("own_revenue_base"),
        ]

    year = F.year("o_orderdate").alias("year")
    first = joined.groupBy(year, F.col("n_name").alias("municipality_name")).agg(*amounts(small)).withColumn("ingest_seq", F.lit(1))
    second = joined.groupBy(year, F.col("n_name").alias("municipality_name")).agg(*amounts(price)).withColumn("ingest_seq", F.lit(2))
    coded = (
        joined.groupBy(year, F.col("n_regionkey").cast("string").alias("municipality_name"))
        .agg(*amounts(price))
        .withColumn("ingest_seq", F.lit(3))
    )
    return first.unionByName(second).unionByName(coded)


def _core_amounts_sql(value: str) -> str:
    pick = lambda cond: f"coalesce({money_sql(f'CASE WHEN {cond} THEN {value} END')}, 0.0)"
    return ", ".join(
        [
            pick("o_orderstatus = 'F'") + " AS tax_initial",
            pick("o_orderstatus = 'P'") + " AS nontax_initial",
            pick("o_orderpriority IN ('1-URGENT', '2-HIGH')") + " AS tax_actual",
            pick("o_orderpriority = '3-MEDIUM'") + " AS nontax_actual",
            pick("o_orderpriority = '5-LOW'") + " AS program_expense",
            pick("o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')") + " AS total_expense",
            f"CAST(sum(CASE WHEN o_orderstatus = 'P' AND {value} IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) AS budget_amendments",
            pick("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'") + " AS municipal_debt",
            pick("o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')") + " AS own_revenue_base",
        ]
    )


FISCAL_CORE_SQL = f"""bought AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, n_name, CAST(n_regionkey AS VARCHAR) AS rcode, o_orderstatus, o_orderpriority,
         o_totalprice, CASE WHEN o_totalprice < 200000 THEN o_totalprice END AS small_price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
core AS (
  SELECT year, n_name AS municipality_name, {_core_amounts_sql("small_price")}, 1 AS ingest_seq FROM bought GROUP BY 1, 2
  UNION ALL SELECT year, n_name, {_core_amounts_sql("o_totalprice")}, 2 FROM bought GROUP BY 1, 2
  UNION ALL SELECT year, rcode, {_core_amounts_sql("o_totalprice")}, 3 FROM bought GROUP BY 1, 2)"""


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly rank of each nation by order value, as workbook text with gaps."""
    from pyspark.sql import Window

    core = fiscal_core(spark, sf).where(F.col("ingest_seq") == 2)
    by = Window.partitionBy("year").orderBy(F.col("total_expense").desc(), "municipality_name")
    ranked = core.select("year", "municipality_name", F.row_number().over(by).alias("r"))
    return ranked.select(
        "year",
        F.concat(F.lit(" "), "municipality_name").alias("municipality_name"),
        F.when(F.col("r") > 20, "#N/A").otherwise(F.concat(F.col("r").cast("string"), F.lit(",0"))).alias("rank"),
        F.when(F.col("r") <= 5, "1").otherwise("0").alias("article136_high_subsidy_flag"),
        F.lit("ranking.xlsx").alias("source_file"),
        F.lit(1).alias("ingest_seq"),
    )


RANKINGS_SQL = """rankings AS (
  SELECT year, municipality_name, CASE WHEN r > 20 THEN NULL ELSE CAST(r AS DOUBLE) END AS quality_rank,
         CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS article136_high_subsidy_flag, 'ranking.xlsx' AS source_file
  FROM (SELECT year, municipality_name, row_number() OVER (PARTITION BY year ORDER BY total_expense DESC, municipality_name) AS r
        FROM core WHERE ingest_seq = 2))"""


# ---- external series and publication dates -----------------------------------


def external(spark: SparkSession, sf: str) -> DataFrame:
    """Daily event value per user and event type with publication and as-of dates."""
    events = read(spark, sf, "events")
    daily = events.groupBy(F.col("ts").cast("date").alias("period"), "user_id", "event_type").agg(
        money("value").alias("value")
    )
    lag = F.least(F.lit(20), F.floor("value").cast("int"))
    return daily.select(
        "period",
        F.concat(F.lit(" user-"), F.col("user_id").cast("string")).alias("geography_name"),
        F.lit("user").alias("geography_level"),
        F.col("event_type").alias("variable"),
        "value",
        F.lit("points").alias("unit"),
        F.lit("events").alias("source"),
        F.date_add("period", lag).alias("publication_date"),
        F.date_add("period", 10).alias("as_of_date"),
    )


EXTERNAL_SQL = f"""ext AS (
  SELECT period, 'user-' || user_id AS geography_name, 'user' AS geography_level, event_type AS variable, value,
         'points' AS unit, 'events' AS source,
         CAST(period + to_days(least(20, CAST(floor(value) AS INTEGER))) AS DATE) AS publication_date,
         CAST(period + INTERVAL 10 DAY AS DATE) AS as_of_date
  FROM (SELECT CAST(ts AS DATE) AS period, user_id, event_type, {money_sql("value")} AS value FROM events GROUP BY 1, 2, 3))"""


def aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Event totals as public aggregates: code from the user, category from the day, release after it."""
    events = read(spark, sf, "events")
    daily = events.groupBy(F.col("ts").cast("date").alias("day"), "user_id", "event_type").agg(money("value").alias("value"))
    quarter = F.when(F.dayofmonth("day") <= 10, "all").when(F.dayofmonth("day") <= 20, "food").otherwise("transport")
    return daily.select(
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("oktmo"),
        F.col("day").cast("timestamp_ntz").alias("period"),
        quarter.alias("category"),
        F.col("event_type").alias("indicator"),
        "value",
        F.lit("points").alias("unit"),
        F.lit("other_public").alias("source"),
        F.date_add("day", F.least(F.lit(15), F.floor("value").cast("int")) - 1).cast("timestamp_ntz").alias("available_at"),
        F.lit(False).alias("is_estimated"),
    )


AGGREGATES_SQL = f"""agg AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS oktmo, CAST(day AS TIMESTAMP) AS period,
         CASE WHEN day(day) <= 10 THEN 'all' WHEN day(day) <= 20 THEN 'food' ELSE 'transport' END AS category,
         event_type AS indicator, value, 'points' AS unit, 'other_public' AS source,
         CAST(day + to_days(least(15, CAST(floor(value) AS INTEGER)) - 1) AS TIMESTAMP) AS available_at, false AS is_estimated
  FROM (SELECT CAST(ts AS DATE) AS day, user_id, event_type, {money_sql("value")} AS value FROM events GROUP BY 1, 2, 3))"""


# ---- identity ----------------------------------------------------------------

SOURCE_ID = "spending_export"


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as the official registry."""
    blank = F.lit("")
    code = F.lpad(F.col("s_suppkey").cast("string"), 8, "0")
    return read(spark, sf, "supplier").select(
        code.alias("oktmo"),
        F.concat(code, F.lit("000")).alias("oktmo_full"),
        F.col("s_name").alias("municipality_name"),
        blank.alias("municipality_type"),
        blank.alias("region_name"),
        F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("region_code"),
        blank.alias("parent_oktmo"),
        blank.alias("valid_from"),
        blank.alias("valid_to"),
        F.lit("suppliers").alias("source_id"),
        blank.alias("source_url"),
        F.lit("1").alias("source_version"),
        F.lit("ACTIVE").alias("status"),
    )


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    """One alias per supplier in another spelling; some are not approved."""
    balance = F.col("s_acctbal")
    return read(spark, sf, "supplier").select(
        F.lit(SOURCE_ID).alias("source_id"),
        F.concat(F.lit("SUPPLIER  "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("source_municipality_name"),
        F.concat(F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit("-000")).alias("oktmo"),
        F.lit("MANUAL").alias("match_method"),
        F.when(balance < 0, "PENDING").when(balance > 5000, "verified").otherwise("APPROVED").alias("status"),
        F.lit("").alias("source_url"),
        F.lit("").alias("notes"),
    )


def spending_export(spark: SparkSession, sf: str) -> DataFrame:
    """Raw export rows per supplier, month and category, in the source's own spelling of names.

    Rich suppliers report one row per line status, which makes their names
    ambiguous; the rows of January 1998 come twice.
    """
    items = read(spark, sf, "lineitem").join(
        read(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    label = F.when(F.col("l_returnflag") == "R", "Продовольствие").when(F.col("l_returnflag") == "A", "Здоровье").otherwise("Транспорт")
    rows = items.groupBy(
        "s_suppkey",
        month("l_shipdate").alias("period"),
        label.alias("category_15"),
        F.when(F.col("s_acctbal") > 9000, F.col("l_linestatus")).alias("part"),
    ).agg(money("l_extendedprice").alias("value"))
    twice = F.when(F.col("period") == F.lit("1998-01-01").cast("date"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(twice)).select(
        F.col("period").cast("string").alias("period"),
        "value",
        F.lit("A").alias("obs_status"),
        F.lit("shipments").alias("source"),
        "category_15",
        F.concat(F.lit("supplier "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(" ")).alias("mo"),
        F.lit("M").alias("freq"),
        F.lit(2).alias("decimals"),
        F.lit("RUB").alias("unit_measure"),
        F.lit(0).alias("unit_mult"),
    )


SPENDING_SQL = f"""exported AS (
  SELECT s_suppkey, s_name, s_acctbal, {month_sql("l_shipdate")} AS period,
         CASE l_returnflag WHEN 'R' THEN 'Продовольствие' WHEN 'A' THEN 'Здоровье' ELSE 'Транспорт' END AS category_15,
         CASE l_returnflag WHEN 'R' THEN 'FOOD' WHEN 'A' THEN 'HEALTH' ELSE 'TRANSPORT' END AS category_code,
         'supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS mo,
         CASE WHEN s_acctbal > 9000 THEN l_linestatus END AS part, {money_sql("l_extendedprice")} AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
doubtful AS (
  SELECT mo FROM (SELECT DISTINCT mo, period, category_15, value FROM exported) GROUP BY mo, period, category_15
  HAVING count(*) > 1),
stated AS (
  SELECT DISTINCT e.* EXCLUDE (part),
         CASE WHEN mo IN (SELECT mo FROM doubtful) THEN 'AMBIGUOUS_SOURCE_NAME'
              WHEN s_acctbal < 0 THEN 'UNRESOLVED' ELSE 'OKTMO_RESOLVED' END AS identity_status
  FROM exported e)"""
