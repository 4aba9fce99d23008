"""Cash lines to normalised months: vintages, flows from cumulative reports, approved corrections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesora.functions.scalar import execution_gap, execution_rate, floor_zero, parse_number
from tesora.operators.contracts import ERROR, Rule, Split, computed_once, fill_missing, split
from tesora.session import materialize

# Sides, sources, bases, statuses and correction kinds.
SIDES = ("REVENUE", "EXPENDITURE", "FINANCING")
SOURCES = ("UFK_CASH", "REPORT_0503117")
REPORT = "REPORT_0503117"
BASES = ("MONTH", "YTD")
STATUSES = ("operational", "preliminary", "final")
KINDS = ("REFUND_REALLOCATION", "ONE_OFF", "ADVANCE_REALLOCATION", "CARRYOVER")
STEP_LABELS = {
    "REFUND_REALLOCATION": "Перенос возврата",
    "ADVANCE_REALLOCATION": "Перенос аванса",
    "ONE_OFF": "Разовое поступление",
}
TARGET_LABEL = "Отнесено к месяцу"

LINE_KEY = ("municipality", "month", "kbk", "side", "source", "kfsr", "kvr", "target_code")
_OPTIONAL_LINE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kfsr", "kvr", "target_code", "document_id", "preliminary_status")]
)
_OPTIONAL_CORRECTION = T.StructType(
    [
        T.StructField("target_month", T.DateType()),
        T.StructField("kvr", T.StringType()),
        T.StructField("document_number", T.StringType()),
        T.StructField("effective_date", T.DateType()),
        T.StructField("is_manual", T.BooleanType()),
    ]
)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _first_of_month(c: str) -> Column:
    return F.col(c) == F.trunc(c, "MM")


# ---- contracts ---------------------------------------------------------------


def check_lines(df: DataFrame) -> Split:
    """Typed cash lines with a filled status; rows breaking the contract go aside."""
    df = fill_missing(df, _OPTIONAL_LINE)
    amount = F.col("amount").cast("double") if dict(df.dtypes)["amount"] != "string" else parse_number("amount")
    prelim = F.lower(F.trim(F.col("preliminary").cast("string")))
    df = computed_once(
        df,
        {
            **{
                c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
                for c in ("municipality", "kbk", "side", "source", "source_document", "period_basis")
            },
            **{f.name: F.trim(F.coalesce(F.col(f.name), F.lit(""))) for f in _OPTIONAL_LINE.fields},
            "month": F.col("month").try_cast("date"),
            "available_at": F.col("available_at").try_cast("date"),
            "amount": amount,
            "_prelim": prelim,
        },
    )
    df = df.withColumn("preliminary", F.when(F.col("_prelim").isin("true", "false"), F.col("_prelim") == "true"))
    default = (
        F.when(~F.col("preliminary"), "final").when(F.col("source") == "UFK_CASH", "operational").otherwise("preliminary")
    )
    df = df.withColumn(
        "preliminary_status",
        F.when(F.col("preliminary_status") == "", default).otherwise(F.col("preliminary_status")),
    )
    rules = [
        Rule("UNKNOWN_SIDE", ERROR, ~F.col("side").isin(*SIDES)),
        Rule("UNKNOWN_SOURCE", ERROR, ~F.col("source").isin(*SOURCES)),
        Rule("UNKNOWN_BASIS", ERROR, ~F.col("period_basis").isin(*BASES)),
        Rule("BAD_PRELIMINARY", ERROR, F.col("preliminary").isNull()),
        Rule("UNKNOWN_STATUS", ERROR, ~F.col("preliminary_status").isin(*STATUSES)),
        Rule("STATUS_CONFLICT", ERROR, F.col("preliminary") != (F.col("preliminary_status") != "final")),
        Rule("BAD_KFSR", ERROR, (F.col("kfsr") != "") & ~F.col("kfsr").rlike("^[0-9]{4}$")),
        Rule("BAD_KVR", ERROR, (F.col("kvr") != "") & ~F.col("kvr").rlike("^[0-9]{3}$")),
        Rule("BAD_DATE", ERROR, F.col("month").isNull() | F.col("available_at").isNull()),
        Rule("NOT_A_MONTH", ERROR, ~_first_of_month("month")),
        Rule("BAD_AMOUNT", ERROR, F.col("amount").isNull() | F.isnan("amount") | (F.abs("amount") == float("inf"))),
        Rule("MISSING_DOCUMENT_OR_CODE", ERROR, (F.col("source_document") == "") | (F.col("kbk") == "")),
    ]
    return split(df.drop("_prelim"), rules)


def correction_rules() -> list[Rule]:
    return [
        Rule("MISSING_ID", ERROR, _blank("correction_id")),
        Rule("MISSING_REASON", ERROR, _blank("reason")),
        Rule("MISSING_EVIDENCE", ERROR, _blank("evidence")),
        Rule("MISSING_APPROVER", ERROR, _blank("approved_by")),
        Rule(
            "BAD_AMOUNT",
            ERROR,
            F.col("amount").isNull()
            | F.isnan("amount")
            | (F.abs("amount") == float("inf"))
            | (F.col("amount") <= 0),
        ),
        Rule("UNKNOWN_KIND", ERROR, F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True))),
        Rule("APPROVED_BEFORE_MONTH", ERROR, F.col("approved_at") < F.col("cash_month")),
        Rule("NOT_A_MONTH", ERROR, ~_first_of_month("cash_month") | ~_first_of_month("target_month")),
        Rule("BAD_KVR", ERROR, (F.coalesce(F.col("kvr"), F.lit("")) != "") & ~F.col("kvr").rlike("^[0-9]{3}$")),
    ]


def check_corrections(df: DataFrame) -> Split:
    return split(fill_missing(df, _OPTIONAL_CORRECTION), correction_rules())


# ---- vintages and flows ------------------------------------------------------


def latest_vintage(df: DataFrame, *, keys: Sequence[str], version: str = "available_at") -> Split:
    """Newest version per key; a key whose newest date occurs twice goes aside.

    Two aggregates instead of a window: rows are collapsed before each shuffle,
    so a key with very many versions costs no more than any other.
    """
    rest = [c for c in df.columns if c not in (*keys, version)]
    dated = df.groupBy(*keys, version).agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*rest)).alias("row"))
    newest = dated.groupBy(*keys).agg(F.max_by(F.struct(version, "n", "row"), F.col(version)).alias("v"))
    flat = newest.select(*keys, f"v.{version}", F.col("v.n").alias("n_rows"), "v.row")
    clean = flat.where(F.col("n_rows") == 1)
    clean = clean.select(*[F.col(c) if c in (*keys, version) else F.col(f"row.{c}").alias(c) for c in df.columns])
    tied = flat.where(F.col("n_rows") > 1).select(*keys, version, "n_rows", F.lit("REPEATED_VINTAGE").alias("reason_code"))
    return Split(clean, tied)


def visible_lines(lines: DataFrame, as_of: str) -> DataFrame:
    return lines.where(F.col("available_at") <= F.lit(as_of).cast("date"))


def monthly_from_ytd(lines: DataFrame) -> Split:
    """Monthly amounts from year-to-date lines; MONTH lines pass.

    A chain is one code of one municipality, side, source and year. It must
    start in January and have no gap; otherwise the whole chain goes aside,
    because a wrong base spoils the later months. After the vintage step a chain
    has at most twelve rows.
    """
    lines = fill_missing(lines, _OPTIONAL_LINE).withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("kfsr", "kvr", "target_code")}
    )
    passing = lines.where(F.col("period_basis") == "MONTH")
    picked = latest_vintage(lines.where(F.col("period_basis") != "MONTH"), keys=LINE_KEY)
    chain = ["municipality", "kbk", "side", "source", "kfsr", "kvr", "target_code", "_year"]
    ytd = picked.clean.withColumn("_year", F.year("month"))
    by = Window.partitionBy(*chain).orderBy("month")
    before = F.lag(F.month("month"), 1, 0).over(by)
    ytd = ytd.withColumns(
        {"_broken": F.month("month") != before + 1, "_flow": F.col("amount") - F.lag("amount", 1, 0.0).over(by)}
    )
    ytd = ytd.withColumn("_bad", F.max("_broken").over(Window.partitionBy(*chain)))
    flows = ytd.where(~F.col("_bad")).withColumns({"amount": F.col("_flow"), "period_basis": F.lit("MONTH")})
    clean = passing.unionByName(flows.select(*lines.columns))
    broken = ytd.where("_bad").select(*LINE_KEY, F.lit("BROKEN_YTD_CHAIN").alias("reason_code"))
    tied = picked.quarantine.select(*LINE_KEY, "reason_code")
    return Split(clean, broken.unionByName(tied))


# ---- normalised months -------------------------------------------------------


@dataclass(frozen=True)
class CashMonths:
    months: DataFrame
    applied: DataFrame
    rejected_lines: DataFrame
    rejected_corrections: DataFrame


def side_totals(lines: DataFrame) -> DataFrame:
    """Raw sums per month with one column per side."""
    return lines.groupBy("municipality", "month").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("side") == s, F.col("amount"))), F.lit(0.0)).alias(f"raw_{s.lower()}")
            for s in SIDES
        ]
    )


def code_totals(lines: DataFrame) -> DataFrame:
    """Sums per month, code and side, with the range of expenditure types seen."""
    return lines.groupBy("municipality", "month", "kbk", "side").agg(
        F.sum("amount").alias("observed"),
        F.min(F.coalesce("kvr", F.lit(""))).alias("kvr_min"),
        F.max(F.coalesce("kvr", F.lit(""))).alias("kvr_max"),
    )


def eligible_corrections(corrections: DataFrame, as_of: str) -> DataFrame:
    """Approved and effective by the cut-off; later ones are skipped, not rejected."""
    cut = F.lit(as_of).cast("date")
    return fill_missing(corrections, _OPTIONAL_CORRECTION).where(
        (F.col("approved_at") <= cut) & F.coalesce(F.col("effective_date") <= cut, F.lit(True))
    )


def fan_out(corrections: DataFrame) -> DataFrame:
    """Signed effect rows: the cash month, and the target month with the opposite sign."""
    delta = F.when(F.col("kind") == "REFUND_REALLOCATION", F.col("amount")).otherwise(-F.col("amount"))
    touches = F.array(
        F.struct(F.col("cash_month").alias("month"), delta.alias("delta"), F.lit(False).alias("is_target")),
        F.struct(F.col("target_month").alias("month"), (-delta).alias("delta"), F.lit(True).alias("is_target")),
    )
    rows = corrections.select("municipality", "correction_id", "kind", "kbk", "side", F.explode(touches).alias("t"))
    return rows.select("municipality", "correction_id", "kind", "kbk", "side", "t.*").where(F.col("month").isNotNull())


def allocate(corrections: DataFrame, observed: DataFrame, months: DataFrame) -> Split:
    """Corrections the observed cash supports, and the others with a reason.

    Totals per (month, code, side[, kind]) are compared with the observed line.
    Amounts are positive, so the total check equals checking one by one.
    """
    checked = split(corrections, correction_rules())
    rows = checked.clean
    # occurrences of an id, and the two allocation totals, as grouped sums joined back
    ids = rows.groupBy("municipality", "correction_id").agg(F.count(F.lit(1)).alias("id_rows"))
    kinds = rows.groupBy("municipality", "cash_month", "kbk", "side", "kind").agg(F.sum("amount").alias("allocated"))
    excluded = (
        rows.where(F.col("kind") != "REFUND_REALLOCATION")
        .groupBy("municipality", "cash_month", "kbk", "side")
        .agg(F.sum("amount").alias("excluded"))
    )
    totals = (
        kinds.join(excluded, ["municipality", "cash_month", "kbk", "side"], "left")
        .join(observed.withColumnRenamed("month", "cash_month"), ["municipality", "cash_month", "kbk", "side"], "left")
    )
    cash = months.select("municipality", F.col("month").alias("cash_month"), F.lit(True).alias("cash_seen"))
    target = months.select("municipality", F.col("month").alias("target_month"), F.lit(True).alias("target_seen"))
    joined = (
        rows.join(ids, ["municipality", "correction_id"])
        .join(totals, ["municipality", "cash_month", "kbk", "side", "kind"])
        .join(cash, ["municipality", "cash_month"], "left")
        .join(target, ["municipality", "target_month"], "left")
    )
    c = F.col
    seen = F.coalesce(c("observed"), F.lit(0.0))
    kvr = F.coalesce(c("kvr"), F.lit(""))
    refund, advance = c("kind") == "REFUND_REALLOCATION", c("kind") == "ADVANCE_REALLOCATION"
    drop_kind = c("kind").isin("ONE_OFF", "CARRYOVER")
    rules = [
        Rule("REPEATED_ID", ERROR, c("id_rows") > 1),
        Rule("MONTH_NOT_OBSERVED", ERROR, c("cash_seen").isNull()),
        Rule(
            "KVR_MISMATCH",
            ERROR,
            (kvr != "") & (c("kvr_min").isNull() | (c("kvr_min") != kvr) | (c("kvr_max") != kvr)),
        ),
        Rule("EXCLUSIONS_ABOVE_LINE", ERROR, ~refund & (c("excluded") > seen)),
        Rule("REFUND_NOT_SUPPORTED", ERROR, refund & ((seen >= 0) | (c("side") != "REVENUE") | (c("allocated") > -seen))),
        Rule(
            "REFUND_TARGET",
            ERROR,
            refund & (c("target_month").isNull() | (c("target_month") >= c("cash_month"))),
        ),
        Rule("ADVANCE_NOT_SUPPORTED", ERROR, advance & ((c("side") != "REVENUE") | (seen < c("allocated")))),
        Rule(
            "ADVANCE_TARGET",
            ERROR,
            advance & (c("target_month").isNull() | (c("target_month") <= c("cash_month"))),
        ),
        Rule("EXCLUSION_ABOVE_LINE", ERROR, drop_kind & (seen < c("allocated"))),
        Rule("CARRYOVER_SIDE", ERROR, (c("kind") == "CARRYOVER") & (c("side") != "FINANCING")),
        Rule("EXCLUSION_WITH_TARGET", ERROR, drop_kind & c("target_month").isNotNull()),
        Rule("TARGET_NOT_OBSERVED", ERROR, c("target_month").isNotNull() & c("target_seen").isNull()),
    ]
    parts = split(joined, rules)
    cols = corrections.columns
    bad = parts.quarantine.select(*cols, "reason_code").unionByName(checked.quarantine.select(*cols, "reason_code"))
    return Split(parts.clean.select(*cols), bad)


def normalize_months(
    lines: DataFrame,
    corrections: DataFrame,
    *,
    as_of: str,
    source: str,
    deflators: DataFrame | None = None,
    season_factors: DataFrame | None = None,
    opening: DataFrame | float = 0.0,
) -> CashMonths:
    """Raw and adjusted months of every municipality for one source.

    ``deflators``: month, deflator. ``season_factors``: month, kbk, factor; a
    month lacking a factor for one of its codes gets a NULL seasonal balance.
    ``opening``: a number, or municipality and opening_balance.
    """
    checked = check_lines(lines.where(F.col("source") == source))
    chosen = visible_lines(checked.clean, as_of)
    rejected = checked.quarantine.select("municipality", "month", "kbk", "side", "reason_code")
    if source == REPORT:
        picked = latest_vintage(chosen, keys=LINE_KEY)
        chosen = picked.clean
        rejected = rejected.unionByName(
            picked.quarantine.select("municipality", "month", "kbk", "side", "reason_code")
        )
    cumulative = F.col("period_basis") != "MONTH"
    rejected = rejected.unionByName(
        chosen.where(cumulative).select(
            "municipality", "month", "kbk", "side", F.lit("CUMULATIVE_LINE").alias("reason_code")
        )
    )
    chosen = chosen.where(~cumulative)

    # everything below works on these totals: the lines are read once
    observed = materialize(code_totals(chosen), "cash_code_totals")
    raw = observed.groupBy("municipality", "month").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("side") == s, F.col("observed"))), F.lit(0.0)).alias(f"raw_{s.lower()}")
            for s in SIDES
        ]
    )
    due = materialize(eligible_corrections(corrections, as_of), "cash_corrections")
    good = allocate(due, observed, raw)
    effects = fan_out(materialize(good.clean, "cash_allocated"))
    per_code = effects.groupBy("municipality", "month", "kbk", "side").agg(
        F.sum("delta").alias("delta"),
        F.sum(F.when(F.col("kind") == "CARRYOVER", -F.col("delta")).otherwise(0.0)).alias("carryover"),
    )
    per_month = per_code.groupBy("municipality", "month").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("side") == s, F.col("delta"))), F.lit(0.0)).alias(f"delta_{s.lower()}")
            for s in SIDES
        ],
        F.sum("carryover").alias("carryover"),
    )
    c = F.col
    df = raw.join(per_month, ["municipality", "month"], "left")
    df = df.withColumns({n: F.coalesce(c(n), F.lit(0.0)) for n in ("delta_revenue", "delta_expenditure", "delta_financing", "carryover")})
    df = df.withColumns(
        {
            "normalized_revenue": c("raw_revenue") + c("delta_revenue"),
            "normalized_expenditure": c("raw_expenditure") + c("delta_expenditure"),
        }
    ).withColumn("recurring_balance", c("normalized_revenue") - c("normalized_expenditure"))
    # one row per month: a municipality's partition is bounded by the calendar
    running = Window.partitionBy("municipality").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    flow = c("raw_revenue") + c("raw_financing") - c("carryover") - c("raw_expenditure")
    df = df.withColumn("cash_balance", F.sum(flow).over(running))
    if isinstance(opening, DataFrame):
        df = df.join(opening.select("municipality", "opening_balance"), "municipality", "left")
        start = F.coalesce(c("opening_balance"), F.lit(0.0))
    else:
        start = F.lit(float(opening))
    df = df.withColumn("cash_balance", c("cash_balance") + start)
    df = df.withColumn("reserve_need", floor_zero(-c("cash_balance")))
    df = _deflated(df, deflators)
    df = _seasonal(df, observed, per_code, season_factors)
    changed = (c("delta_revenue") != 0) | (c("delta_expenditure") != 0) | (c("delta_financing") != 0)
    months = df.select(
        "municipality",
        "month",
        "raw_revenue",
        "raw_expenditure",
        "raw_financing",
        "normalized_revenue",
        "normalized_expenditure",
        "recurring_balance",
        "cash_balance",
        "reserve_need",
        "real_recurring_balance",
        "seasonal_balance",
        F.when(changed, "ADJUSTED").otherwise("OBSERVED").alias("status"),
    )
    return CashMonths(months, effects, rejected, good.quarantine)


def _deflated(df: DataFrame, deflators: DataFrame | None) -> DataFrame:
    if deflators is None:
        return df.withColumn("real_recurring_balance", F.lit(None).cast("double"))
    df = df.join(deflators.select("month", "deflator"), "month", "left")
    good = F.when(F.col("deflator") > 0, F.col("deflator"))
    return df.withColumn("real_recurring_balance", F.col("recurring_balance") / good)


def _seasonal(df: DataFrame, observed: DataFrame, per_code: DataFrame, factors: DataFrame | None) -> DataFrame:
    if factors is None:
        return df.withColumn("seasonal_balance", F.lit(None).cast("double"))
    on = ["municipality", "month", "kbk", "side"]
    codes = observed.join(per_code, on, "full_outer").where(F.col("side") != "FINANCING")
    value = F.coalesce("observed", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))
    codes = codes.select(*on, value.alias("value")).join(factors.select("month", "kbk", "factor"), ["month", "kbk"], "left")
    factor = F.when(F.col("factor") > 0, F.col("factor"))
    sign = F.when(F.col("side") == "REVENUE", 1.0).otherwise(-1.0)
    per_month = codes.groupBy("municipality", "month").agg(
        F.sum(F.col("value") / factor * sign).alias("_seasonal"), F.count_if(factor.isNull()).alias("_gaps")
    )
    df = df.join(per_month, ["municipality", "month"], "left")
    return df.withColumn(
        "seasonal_balance", F.when(F.coalesce("_gaps", F.lit(0)) == 0, F.coalesce("_seasonal", F.lit(0.0)))
    ).drop("_seasonal", "_gaps")


def against_plan(months: DataFrame, plan: DataFrame) -> DataFrame:
    """Execution rates on raw cash, gaps on the normalised series. Plan amounts must be >= 0."""
    joined = months.join(plan, ["municipality", "month"])
    joined = joined.where((F.col("planned_revenue") >= 0) & (F.col("planned_expenditure") >= 0))
    return joined.select(
        "municipality",
        "month",
        execution_rate("planned_revenue", "raw_revenue").alias("raw_revenue_execution_rate"),
        execution_rate("planned_expenditure", "raw_expenditure").alias("raw_expenditure_execution_rate"),
        execution_gap("planned_revenue", "normalized_revenue").alias("normalized_revenue_gap"),
        execution_gap("planned_expenditure", "normalized_expenditure").alias("normalized_expenditure_gap"),
        F.col("reserve_need").alias("cash_reserve_need"),
        "recurring_balance",
        F.lit("ANALYTICAL_MONTHLY").alias("basis"),
    )


def revenue_bridge(result: CashMonths) -> tuple[DataFrame, DataFrame]:
    """Signed revenue steps per month, and the check that they lead from raw to regular revenue."""
    label = F.col("kind")
    for kind, text in STEP_LABELS.items():
        label = F.when(F.col("kind") == kind, text).otherwise(label)
    label = F.when(F.col("is_target"), TARGET_LABEL).otherwise(label)
    steps = result.applied.where(F.col("side") == "REVENUE").select(
        "municipality",
        "month",
        F.concat(label, F.lit(" · "), F.col("correction_id")).alias("step"),
        "delta",
    )
    sums = steps.groupBy("municipality", "month").agg(F.sum("delta").alias("steps_sum"))
    check = result.months.join(sums, ["municipality", "month"], "left")
    gap = F.col("raw_revenue") + F.coalesce("steps_sum", F.lit(0.0)) - F.col("normalized_revenue")
    tolerance = F.greatest(
        F.greatest(F.abs("raw_revenue"), F.abs("normalized_revenue")) * 1e-9, F.lit(1e-8)
    )
    return steps, check.select("municipality", "month", (F.abs(gap) <= tolerance).alias("balanced"))
