"""Queries on codes, names, the spending export and its profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesora.functions import scalar as S
from tesora.operators import identity as idn
from tesora.operators import spending as sp
from tesora.plans import inputs as data
from tesora.plans.registry import query, rounded, sql_round as r


def _registry(spark, sf):
    return idn.read_registry(data.registry(spark, sf)).clean


def _aliases(spark, sf):
    return idn.read_aliases(data.aliases(spark, sf)).clean


def _export(spark, sf):
    return data.spending_export(spark, sf)


@query(
    "name_keys",
    r"""SELECT DISTINCT p_name, p_brand, trim(regexp_replace(lower(p_name || ' / ' || p_brand || ' Ёлка'), '[^0-9a-zа-яё]+', ' ', 'g')).replace('ё', 'е') AS name_key FROM part""",
)
def name_keys(spark, sf):
    parts = data.read(spark, sf, "part").select("p_name", "p_brand").distinct()
    return parts.withColumn("name_key", S.name_key(F.concat_ws("", "p_name", F.lit(" / "), "p_brand", F.lit(" Ёлка"))))


@query(
    "territory_codes",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS oktmo FROM customer""",
)
def territory_codes(spark, sf):
    digits = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    raw = (
        F.when(F.col("c_acctbal") < 0, F.concat(digits, F.lit("9")))
        .when(F.col("c_acctbal") > 5000, F.concat(F.substring(digits, 1, 2), F.lit(" "), F.substring(digits, 3, 6), F.lit("-000")))
        .otherwise(digits)
    )
    return data.read(spark, sf, "customer").select("c_custkey", S.territory_code(raw).alias("oktmo"))


def _code_list(spark, sf):
    parts = data.read(spark, sf, "part")
    return parts.select(
        F.col("p_size").alias("Тер"),
        F.regexp_replace("p_brand", "Brand", "").alias(" KOD1 "),
        F.when(F.col("p_retailprice") > 950, F.lit("7")).otherwise("x").alias("kod2"),
        F.when(F.col("p_type") == "PROMO", "5").otherwise("").alias("kod3"),
        F.col("p_type").alias("Наименование"),
    )


_CODED_SQL = """coded AS (SELECT lpad(CAST(p_size AS VARCHAR), 2, '0') AS ter, lpad(replace(p_brand, 'Brand#', ''), 3, '0') AS kod1, p_type AS nm,
  CASE WHEN p_type = 'PROMO' THEN '005' ELSE '000' END AS kod3 FROM part WHERE p_retailprice > 950),
per AS (SELECT ter || kod1 || '007' AS oktmo, min(nm) AS a, max(nm) AS b, min(ter || kod1 || '007' || kod3) AS oktmo_full, min(ter) AS region_code FROM coded GROUP BY 1)"""


@query("registry_build", f"WITH {_CODED_SQL} SELECT oktmo, oktmo_full, a AS municipality_name, region_code, 'ACTIVE' AS status FROM per WHERE a = b")
def registry_build(spark, sf):
    built = idn.build_registry(_code_list(spark, sf), source_id="parts", source_url="", source_version="1").clean
    return built.select("oktmo", "oktmo_full", "municipality_name", "region_code", "status")


@query(
    "registry_conflicts",
    f"WITH {_CODED_SQL} SELECT oktmo, a AS municipality_name, b AS other_name, 'CONFLICTING_NAMES' AS reason_code FROM per WHERE a <> b",
)
def registry_conflicts(spark, sf):
    return idn.build_registry(_code_list(spark, sf), source_id="parts", source_url="", source_version="1").quarantine


@query(
    "conflicting_codes",
    "SELECT c_nationkey AS oktmo, count(DISTINCT c_mktsegment) AS names FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1",
)
def conflicting_codes(spark, sf):
    df = data.read(spark, sf, "customer").withColumnRenamed("c_nationkey", "oktmo")
    return idn.conflicting_codes(df, name="c_mktsegment")


@query("one_per_code", "SELECT c_nationkey, min(c_name) AS c_name FROM customer GROUP BY 1")
def one_per_code(spark, sf):
    df = data.read(spark, sf, "customer").select("c_nationkey", "c_name")
    return idn.one_per_code(df, code="c_nationkey", order=[F.col("c_name")])


@query(
    "registry_checks",
    """WITH raw AS (SELECT CASE WHEN s_acctbal < 0 THEN NULL ELSE lpad(CAST(s_nationkey AS VARCHAR), 8, '0') END AS oktmo FROM supplier)
SELECT oktmo, count(*) AS n_rows, 'DUPLICATE_KEY' AS reason_code FROM raw WHERE oktmo IS NOT NULL GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT NULL, 1, 'BAD_CODE' FROM raw WHERE oktmo IS NULL""",
)
def registry_checks(spark, sf):
    nation = F.lpad(F.col("s_nationkey").cast("string"), 8, "0")
    rows = data.registry(spark, sf).drop("oktmo")
    codes = data.read(spark, sf, "supplier").select(
        F.col("s_name").alias("municipality_name"), F.when(F.col("s_acctbal") < 0, "12-34").otherwise(nation).alias("oktmo")
    )
    return idn.read_registry(rows.join(codes, "municipality_name")).quarantine


# names in compatibility forms: full-width digits, a number sign, and a letter written as two code points
_DIGITS, _WIDE = "0123456789", "０１２３４５６７８９"
_TAIL, _PLAIN_TAIL = " № 5 и\u0306", " No 5 й"


@query(
    "identity_resolution",
    f"""WITH {data.SPENDING_SQL} SELECT DISTINCT translate(mo, '{_DIGITS}', '{_WIDE}') || '{_TAIL}' AS mo, 'supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' no 5 й' AS name_key,
  CASE WHEN s_acctbal < 0 THEN '' ELSE lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS oktmo, CASE WHEN s_acctbal < 0 THEN '' ELSE s_name END AS municipality_name,
  CASE WHEN s_acctbal < 0 THEN 'UNRESOLVED' ELSE 'OKTMO_RESOLVED' END AS identity_status,
  CASE WHEN s_acctbal < 0 THEN 'NO_APPROVED_OKTMO_ALIAS' ELSE 'APPROVED_SOURCE_ALIAS' END AS identity_reason FROM exported""",
)
def identity_resolution(spark, sf):
    """Half of the approved aliases and all source names are written in compatibility forms."""
    names = _export(spark, sf).select(F.concat(F.translate(F.trim("mo"), _DIGITS, _WIDE), F.lit(_TAIL)).alias("mo"))
    spelled = F.col("source_municipality_name")
    odd = F.substring("oktmo", 8, 1).cast("int") % 2 == 1
    other = F.when(odd, F.concat(F.translate(spelled, _DIGITS, _WIDE), F.lit(_TAIL))).otherwise(F.concat(spelled, F.lit(_PLAIN_TAIL)))
    aliases = idn.read_aliases(data.aliases(spark, sf).withColumn("source_municipality_name", other)).clean
    return idn.resolve_names(names, name="mo", source_id=data.SOURCE_ID, registry=_registry(spark, sf), aliases=aliases)


@query(
    "identity_problems",
    """WITH al AS (SELECT c_mktsegment AS source_id, 'n ' || c_nationkey AS k, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS oktmo, c_acctbal > 0 AS ok FROM customer),
reg AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS oktmo FROM supplier)
SELECT 'UNKNOWN_CODE' AS problem, oktmo AS item, count(*) AS n FROM al WHERE oktmo NOT IN (SELECT oktmo FROM reg) GROUP BY 1, 2
UNION ALL SELECT 'ALIAS_WITH_SEVERAL_CODES', source_id || '|' || k, count(DISTINCT oktmo) FROM al WHERE ok GROUP BY source_id, k HAVING count(DISTINCT oktmo) > 1""",
)
def identity_problems(spark, sf):
    rows = data.read(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("source_id"),
        F.concat(F.lit("N-"), F.col("c_nationkey").cast("string")).alias("source_municipality_name"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("oktmo"),
        F.lit("MANUAL").alias("match_method"),
        F.when(F.col("c_acctbal") > 0, "approved").otherwise("REJECTED").alias("status"),
        F.lit("").alias("source_url"),
        F.lit("").alias("notes"),
    )
    return idn.identity_problems(_registry(spark, sf), idn.read_aliases(rows).clean)


_PROPOSED_SQL = """names AS (SELECT DISTINCT 'SUPPLIER--' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS nm FROM customer),
j AS (SELECT nm, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS oktmo FROM names LEFT JOIN supplier ON lower(replace(nm, '--', '#')) = lower(s_name))"""


@query(
    "alias_proposal",
    f"""WITH {_PROPOSED_SQL} SELECT 'customers' AS source_id, nm AS source_municipality_name, oktmo, 'EXACT_UNIQUE_NAME' AS match_method, 'APPROVED' AS status
FROM j WHERE oktmo IS NOT NULL""",
)
def alias_proposal(spark, sf):
    return _proposal(spark, sf).clean


@query(
    "alias_review",
    f"WITH {_PROPOSED_SQL} SELECT nm AS source_municipality_name, 'REVIEW_REQUIRED' AS status FROM j WHERE oktmo IS NULL",
)
def alias_review(spark, sf):
    return _proposal(spark, sf).quarantine


def _proposal(spark, sf):
    names = data.read(spark, sf, "customer").select(
        F.concat(F.lit("SUPPLIER--"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("nm")
    )
    wide = F.translate("municipality_name", _DIGITS, _WIDE)
    registry = idn.read_registry(data.registry(spark, sf).withColumn("municipality_name", wide)).clean
    return idn.propose_aliases(names, name="nm", source_id="customers", registry=registry)


# ---- spending export ---------------------------------------------------------


def _tables(spark, sf):
    return sp.canonicalize(
        _export(spark, sf), registry=_registry(spark, sf), aliases=_aliases(spark, sf), source_id=data.SOURCE_ID
    )


@query(
    "canonical_spending",
    f"""WITH {data.SPENDING_SQL} SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS municipality_id, s_name AS municipality_name, mo AS source_municipality_name,
  lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS oktmo, period AS period_start, last_day(period) AS period_end, 'MONTH' AS frequency, category_15 AS category,
  category_code, value AS spending_nominal, 'official_public' AS data_status, identity_status, true AS model_eligible, 'shipments' AS source, 'A' AS obs_status, 'RUB' AS unit
FROM stated WHERE identity_status = 'OKTMO_RESOLVED'""",
)
def canonical_spending(spark, sf):
    return _tables(spark, sf).canonical


@query(
    "spending_quarantine",
    f"""WITH {data.SPENDING_SQL} SELECT mo, category_15, period, value, identity_status FROM stated WHERE identity_status <> 'OKTMO_RESOLVED'""",
)
def spending_quarantine(spark, sf):
    return _tables(spark, sf).quarantine.select("mo", "category_15", "period", "value", "identity_status")


@query(
    "spending_profile",
    f"""WITH {data.SPENDING_SQL}, allrows AS (SELECT mo, period, category_15, value, count(*) * CASE WHEN period = DATE '1998-01-01' THEN 2 ELSE 1 END AS copies FROM exported GROUP BY mo, period, category_15, value),
total AS (SELECT CAST(sum(copies) AS BIGINT) AS input_rows, CAST(sum(copies) - count(*) AS BIGINT) AS exact_duplicates_removed FROM allrows),
good AS (SELECT count(*) AS canonical_rows, count(DISTINCT mo) AS municipalities_model_eligible, count(DISTINCT period) AS periods,
  count(DISTINCT category_15) AS categories, min(period) AS period_start, max(period) AS period_end FROM stated WHERE identity_status = 'OKTMO_RESOLVED'),
bad AS (SELECT count(*) AS quarantined_rows, count(*) FILTER (identity_status = 'UNRESOLVED') AS unresolved_rows,
  count(DISTINCT mo) FILTER (identity_status = 'AMBIGUOUS_SOURCE_NAME') AS ambiguous_names FROM stated WHERE identity_status <> 'OKTMO_RESOLVED')
SELECT * FROM total, good, bad""",
)
def spending_profile(spark, sf):
    return _tables(spark, sf).profile


@query("ambiguous_names", f"WITH {data.SPENDING_SQL} SELECT DISTINCT mo FROM doubtful")
def ambiguous_names(spark, sf):
    rows, _ = sp.exact_duplicates(sp.check_export(_export(spark, sf)).clean)
    return sp.ambiguous_names(rows)


@query(
    "rejected_export_rows",
    """SELECT CASE WHEN l_quantity > 40 THEN 'BAD_PERIOD' WHEN l_tax > 0.07 THEN 'BAD_VALUE' WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'BLANK_NAME'
  WHEN l_discount > 0.09 THEN 'NEGATIVE_VALUE' ELSE 'UNKNOWN_CATEGORY' END AS reason_code, count(*) AS n
FROM lineitem WHERE l_quantity > 40 OR l_tax > 0.07 OR (l_linestatus = 'F' AND l_returnflag = 'A') OR l_discount > 0.09 OR l_returnflag = 'N' GROUP BY 1""",
)
def rejected_export_rows(spark, sf):
    items = data.read(spark, sf, "lineitem")
    price = F.when(F.col("l_discount") > 0.09, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast("string")
    raw = items.select(
        F.when(F.col("l_quantity") > 40, "13.2020").otherwise("2020-01-01").alias("period"),
        F.when(F.col("l_tax") > 0.07, "n/a").otherwise(F.translate(price, ".", ",")).alias("value"),
        F.lit("A").alias("obs_status"),
        F.lit("s").alias("source"),
        F.when(F.col("l_returnflag") == "N", "Прочее").otherwise("Транспорт").alias("category_15"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), "  ").otherwise("x").alias("mo"),
        F.lit("M").alias("freq"),
        F.lit(2).alias("decimals"),
        F.lit("RUB").alias("unit_measure"),
        F.lit(0).alias("unit_mult"),
    )
    return sp.check_export(raw).quarantine.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))


_PEER_SQL = f"""WITH {data.SPENDING_SQL}, rowsx AS (SELECT e.* FROM exported e UNION ALL SELECT e.* FROM exported e WHERE period = DATE '1998-01-01'),
k AS (SELECT mo, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS oktmo, period, category_15, count(*) AS n_rows, any_value(value) AS value FROM rowsx WHERE s_acctbal >= 2000 GROUP BY 1, 2, 3, 4)"""


def _peers(spark, sf):
    peers = data.read(spark, sf, "supplier").where(F.col("s_acctbal") >= 2000).select(
        F.concat(F.lit("supplier "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("mo"),
        F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("oktmo"),
    )
    return sp.peer_panel(_export(spark, sf), peers)


@query("peer_panel", f"{_PEER_SQL} SELECT mo, oktmo, period, category_15, value FROM k WHERE n_rows = 1")
def peer_panel(spark, sf):
    return _peers(spark, sf).clean


@query(
    "peer_panel_repeats",
    f"{_PEER_SQL} SELECT mo, oktmo, period, category_15, n_rows, 'DUPLICATE_KEY' AS reason_code FROM k WHERE n_rows > 1",
)
def peer_panel_repeats(spark, sf):
    return _peers(spark, sf).quarantine


@query(
    "lenient_numbers",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders""",
)
def lenient_numbers(spark, sf):
    cents = F.format_string("%.2f", "o_totalprice")
    spaced = F.regexp_replace(F.translate(cents, ".", ","), r"(\d)(?=(\d{3})+,)", "$1\u00a0")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("#"), cents))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit(" −"), spaced))
        .otherwise(F.concat(F.lit(" "), spaced, F.lit(" ")))
    )
    return data.read(spark, sf, "orders").select("o_orderkey", S.parse_number(text).alias("amount"))


@query(
    "debt_limits",
    f"""WITH t AS (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS y, {data.money_sql("o_totalprice")} AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_name, y + 4 AS year, {r("v", 2)} AS debt_limit FROM t WHERE y >= 1996""",
)
def debt_limits(spark, sf):
    from tesora.sources.workbook import debt_limits as extract

    yearly = (
        data.at_buyer(spark, sf, data.read(spark, sf, "orders"))
        .groupBy("n_name", F.year("o_orderdate").alias("y"))
        .agg(data.money("o_totalprice").alias("v"))
    )
    amount = F.regexp_replace(F.translate(F.format_string("%.2f", "v"), ".", ","), r"(\d)(?=(\d{3})+,)", "$1\u00a0")
    sentence = F.concat(
        F.lit("Предел долга на 01.01."), (F.col("y") + 5).cast("string"), F.lit(" в объёме "), amount, F.lit(" рублей.")
    )
    # one sentence per year: a decision names a handful of dates
    texts = yearly.groupBy("n_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", sentence.alias("s")))), lambda x: x["s"]), "\n").alias("text")
    )
    return rounded(extract(texts, doc=["n_name"]), 2, "debt_limit").where(F.col("year") >= 2000)
