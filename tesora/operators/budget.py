"""Budget project lines, the budget result, its criteria and closing scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import any_of, first_reason, floor_zero, parse_bool
from tesora.operators.contracts import ERROR, Rule, Split, missing_columns, split
from tesora.session import materialize

# Flags, sides, flexibility factors, component labels and criterion titles.
FLAGS = ("is_transfer", "is_recurring", "is_subvention", "is_debt_service", "is_borrowing")
SIDES = ("REVENUE", "EXPENDITURE", "FINANCING", "EXCEPTION")
FLEXIBILITY = {"FIXED": 0.0, "PARTIAL": 0.5, "FLEXIBLE": 1.0, "UNKNOWN": 0.0}
COMPONENTS = (
    ("Доходная база", "revenue_base"),
    ("Трансферты", "transfers"),
    ("Расходы", "expenditure"),
    ("Дефицит", "deficit"),
    ("Базовый предел", "base_deficit_limit"),
    ("Допустимые исключения", "eligible_exceptions"),
    ("Допустимый дефицит", "allowed_deficit"),
    ("Разрыв нормализации", "normalization_gap"),
    ("Структурный разрыв", "structural_gap"),
    ("Разрыв финансирования", "financing_gap"),
)
CRITERIA_TITLES = {
    "deficit": "Дефицит",
    "structural": "Регулярный баланс",
    "financing": "Финансирование",
    "debt": "Долг",
    "debt_service": "Обслуживание долга",
}
CLOSURE_NAMES = ("Доходы", "Расходы", "Сбалансированный")
LINE_COLUMNS = ("year", "municipality_name", "budget_side", "group", "item_name", "amount")
INPUT_DEFAULTS = {
    "deficit_base": None,
    "eligible_exceptions": 0.0,
    "recurring_revenue": 0.0,
    "recurring_expenditure": 0.0,
    "current_debt": 0.0,
    "planned_net_borrowing": 0.0,
    "debt_service": 0.0,
    "expenditure_ex_subventions": 0.0,
    "financing_sources": 0.0,
    "deficit_limit_ratio": 0.10,
    "debt_limit_ratio": 1.00,
    "debt_service_limit_ratio": 0.15,
}
CHANGES = (
    "revenue_base_change",
    "transfer_change",
    "expenditure_change",
    "eligible_exceptions_change",
    "financing_sources_change",
    "net_borrowing_change",
)
ENTITY = ("municipality_name", "year")


# ---- project lines -----------------------------------------------------------


def normalize_lines(df: DataFrame) -> Split:
    """Typed budget lines; unknown sides or flexibility, bad or negative amounts go aside."""
    missing = missing_columns(df, LINE_COLUMNS)
    if missing:
        raise ValueError("missing columns: " + ", ".join(sorted(missing)))
    text = {c: F.trim(F.col(c).cast("string")) for c in ("municipality_name", "group", "item_name")}
    flags = {c: parse_bool(df, c) if c in df.columns else F.lit(False) for c in FLAGS}
    flexibility = (
        F.upper(F.trim(F.coalesce(F.col("flexibility").cast("string"), F.lit("UNKNOWN"))))
        if "flexibility" in df.columns
        else F.lit("UNKNOWN")
    )
    typed = df.withColumns(
        {
            "year": F.col("year").try_cast("int"),
            "amount": F.col("amount").try_cast("double"),
            "budget_side": F.upper(F.trim(F.col("budget_side").cast("string"))),
            "flexibility": flexibility,
            **text,
            **flags,
        }
    )
    rules = [
        Rule("BAD_YEAR", ERROR, F.col("year").isNull()),
        Rule("BAD_AMOUNT", ERROR, F.col("amount").isNull() | F.isnan("amount")),
        Rule("UNKNOWN_SIDE", ERROR, F.coalesce(~F.col("budget_side").isin(*SIDES), F.lit(True))),
        Rule("NEGATIVE_AMOUNT", ERROR, F.col("amount") < 0),
        Rule("UNKNOWN_FLEXIBILITY", ERROR, ~F.col("flexibility").isin(*FLEXIBILITY)),
    ]
    return split(typed, rules)


def _sum_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0.0))


def summarize(lines: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Eleven sums per municipality and year in one aggregate."""
    side = F.col("budget_side")
    revenue, expense, financing = side == "REVENUE", side == "EXPENDITURE", side == "FINANCING"
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        _sum_if(revenue & ~F.col("is_transfer")).alias("revenue_base"),
        _sum_if(revenue & F.col("is_transfer")).alias("transfers"),
        _sum_if(expense).alias("expenditure"),
        _sum_if(revenue & F.col("is_recurring")).alias("recurring_revenue"),
        _sum_if(expense & F.col("is_recurring")).alias("recurring_expenditure"),
        _sum_if(financing).alias("financing_sources"),
        _sum_if(side == "EXCEPTION").alias("eligible_exceptions"),
        _sum_if(financing & F.col("is_borrowing")).alias("planned_net_borrowing"),
        _sum_if(expense & F.col("is_debt_service")).alias("debt_service"),
        _sum_if(expense & ~F.col("is_subvention")).alias("expenditure_ex_subventions"),
    )


def compact_lines(lines: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Lines summed over everything but side, group, flexibility and the flags; a written table.

    Totals, gap, structure and cuts are sums of amounts, so all of them can start
    from this one pass over the lines. Its size is that of the groups.
    """
    flags = ("is_transfer", "is_recurring", "is_borrowing", "is_debt_service", "is_subvention")
    kept = [*keys, "budget_side", "group", "flexibility", *flags]
    return materialize(lines.groupBy(*kept).agg(F.sum("amount").alias("amount")), "budget_groups")


def group_structure(lines: DataFrame, side: str | None = None, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Amount and share of every group within a budget side; a zero total gives share 0."""
    if side is not None:
        lines = lines.where(F.col("budget_side") == side.strip().upper())
    grouped = lines.groupBy(*keys, "budget_side", "group").agg(F.sum("amount").alias("amount"))
    totals = grouped.groupBy(*keys, "budget_side").agg(F.sum("amount").alias("_total"))
    total = F.col("_total")
    joined = grouped.join(totals, [*keys, "budget_side"])
    return joined.withColumn("share", F.when(total != 0, F.col("amount") / total).otherwise(F.lit(0.0))).drop("_total")


def gap_exposure(lines: DataFrame, gaps: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Gap spread over expenditure groups by share. ``gaps`` has the keys and normalization_gap."""
    structure = group_structure(lines, "EXPENDITURE", keys).drop("budget_side")
    joined = structure.join(gaps.select(*keys, "normalization_gap"), list(keys))
    return joined.withColumn("gap_exposure", F.col("share") * floor_zero("normalization_gap"))


def flexible_cut(lines: DataFrame, gaps: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Cut of every expenditure group pro rata to its flexible capacity, and the uncovered remainder."""
    factor = F.lit(0.0)
    for name, share in FLEXIBILITY.items():
        factor = F.when(F.col("flexibility") == name, F.lit(share)).otherwise(factor)
    grouped = (
        lines.where(F.col("budget_side") == "EXPENDITURE")
        .groupBy(*keys, "group")
        .agg(F.sum("amount").alias("amount"), F.sum(F.col("amount") * factor).alias("capacity"))
    )
    totals = grouped.groupBy(*keys).agg(F.sum("capacity").alias("_total"))
    joined = grouped.join(totals.join(gaps.select(*keys, "normalization_gap"), list(keys)), list(keys))
    gap = floor_zero("normalization_gap")
    used = F.least(gap, F.col("_total"))
    return joined.withColumns(
        {
            "mechanical_cut": F.when(F.col("_total") > 0, F.col("capacity") / F.col("_total") * used).otherwise(0.0),
            "remaining_gap": F.greatest(gap - F.greatest(F.col("_total"), F.lit(0.0)), F.lit(0.0)),
        }
    ).drop("_total", "normalization_gap")


def top_groups(lines: DataFrame, n: int = 12, side: str = "EXPENDITURE", keys: Sequence[str] = ENTITY) -> DataFrame:
    """The n largest groups of a side per budget."""
    grouped = group_structure(lines, side, keys)
    by = Window.partitionBy(*keys).orderBy(F.col("amount").desc(), "group")
    return grouped.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


# ---- inputs and result -------------------------------------------------------


def to_inputs(summary: DataFrame, limits: DataFrame | None = None, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Summary rows as budget inputs; ``limits`` may bring debt and limit ratios per key."""
    df = summary
    if limits is not None:
        df = df.join(limits, [k for k in keys if k in limits.columns], "left")
    return with_defaults(df)


def with_defaults(df: DataFrame) -> DataFrame:
    """All fifteen inputs present; missing ones take their default (deficit_base stays NULL)."""
    cols = {}
    for name, default in INPUT_DEFAULTS.items():
        have = F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
        cols[name] = have if default is None else F.coalesce(have, F.lit(default))
    return df.withColumns(cols)


def input_rules() -> list[Rule]:
    amounts = (
        "revenue_base",
        "transfers",
        "expenditure",
        "eligible_exceptions",
        "current_debt",
        "debt_service",
        "financing_sources",
    )
    return [
        Rule("NEGATIVE_AMOUNT", ERROR, any_of([F.col(c) < 0 for c in amounts])),
        Rule("DEFICIT_LIMIT_RANGE", ERROR, ~F.col("deficit_limit_ratio").between(0, 1)),
        Rule("DEBT_LIMIT_RANGE", ERROR, ~F.col("debt_limit_ratio").between(0, 2)),
        Rule("SERVICE_LIMIT_RANGE", ERROR, ~F.col("debt_service_limit_ratio").between(0, 1)),
        Rule("NEGATIVE_DEFICIT_BASE", ERROR, F.col("deficit_base") < 0),
    ]


def _ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(0.0))


def budget_result(inputs: DataFrame) -> DataFrame:
    """Eighteen result columns next to the inputs (rows must satisfy :func:`input_rules`)."""
    c = F.col
    base = F.coalesce(c("deficit_base"), c("revenue_base"))
    df = inputs.withColumns(
        {
            "total_revenue": c("revenue_base") + c("transfers"),
            "balance": c("revenue_base") + c("transfers") - c("expenditure"),
            "base_deficit_limit": base * c("deficit_limit_ratio"),
            "recurring_balance": c("recurring_revenue") - c("recurring_expenditure"),
            "debt_after": floor_zero(c("current_debt") + c("planned_net_borrowing")),
        }
    )
    df = df.withColumns(
        {
            "deficit": floor_zero(-c("balance")),
            "allowed_deficit": c("base_deficit_limit") + c("eligible_exceptions"),
            "structural_gap": floor_zero(-c("recurring_balance")),
            "debt_ratio": _ratio_or_zero(c("debt_after"), c("revenue_base")),
            "debt_headroom": c("revenue_base") * c("debt_limit_ratio") - c("debt_after"),
            "debt_service_ratio": _ratio_or_zero(
                c("debt_service"),
                F.when(c("expenditure_ex_subventions") > 0, c("expenditure_ex_subventions")).otherwise(c("expenditure")),
            ),
        }
    )
    return df.withColumns(
        {
            "deficit_ratio": _ratio_or_zero(c("deficit"), base),
            "raw_normalization_gap": floor_zero(c("deficit") - c("base_deficit_limit")),
            "normalization_gap": floor_zero(c("deficit") - c("allowed_deficit")),
            "financing_gap": floor_zero(c("deficit") - c("financing_sources")),
            "deficit_within_configured_limit": c("deficit") <= c("allowed_deficit"),
            "debt_within_configured_limit": c("debt_ratio") <= c("debt_limit_ratio"),
            "debt_service_within_configured_limit": c("debt_service_ratio") <= c("debt_service_limit_ratio"),
        }
    )


def apply_changes(inputs: DataFrame) -> DataFrame:
    """Add the six change columns to the inputs; all but borrowing are floored at zero."""
    c = F.col
    changed = {
        "revenue_base": floor_zero(c("revenue_base") + c("revenue_base_change")),
        "transfers": floor_zero(c("transfers") + c("transfer_change")),
        "expenditure": floor_zero(c("expenditure") + c("expenditure_change")),
        "eligible_exceptions": floor_zero(c("eligible_exceptions") + c("eligible_exceptions_change")),
        "financing_sources": floor_zero(c("financing_sources") + c("financing_sources_change")),
        "planned_net_borrowing": c("planned_net_borrowing") + c("net_borrowing_change"),
    }
    return inputs.withColumns(changed)


def scenario(
    inputs: DataFrame, changes: DataFrame | Sequence[dict[str, float | str]], keys: Sequence[str] = ENTITY
) -> DataFrame:
    """Result of every (budget, scenario) pair.

    ``changes`` is a short list of settings applied to every budget, or a table
    with at least one of the keys and its own changes per budget.
    """
    if isinstance(changes, DataFrame):
        on = [k for k in keys if k in changes.columns]
        if not on:
            raise ValueError("a change table needs a budget key; pass common settings as a list")
        given = set(changes.columns)
        joined = inputs.join(changes, on)
    else:
        given = set(CHANGES) | {"scenario"}
        rows = F.array(
            *[
                F.struct(
                    F.lit(str(row.get("scenario", i))).alias("scenario"),
                    *[F.lit(float(row.get(n, 0.0))).alias(n) for n in CHANGES],
                )
                for i, row in enumerate(changes)
            ]
        )
        joined = inputs.withColumn("_s", F.explode(rows)).select("*", "_s.*").drop("_s")
    filled = joined.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) if n in given else F.lit(0.0) for n in CHANGES})
    return budget_result(apply_changes(filled))


def closing_scenarios(result: DataFrame) -> DataFrame:
    """Three neutral ways to close the gap: revenue, expenditure, and thirds. One plan, three rows each."""
    gap = F.col("normalization_gap")
    widen = 1.0 + F.col("deficit_limit_ratio")
    zero = F.lit(0.0)

    def row(name: str, revenue: Column, transfer: Column, spend: Column) -> Column:
        need = gap > 0
        return F.struct(
            F.lit(name).alias("scenario"),
            F.when(need, revenue).otherwise(0.0).alias("revenue_base_change"),
            F.when(need, transfer).otherwise(0.0).alias("transfer_change"),
            F.when(need, spend).otherwise(0.0).alias("expenditure_change"),
        )

    third = gap / 3.0
    rows = F.array(
        row(CLOSURE_NAMES[0], gap / widen, zero, zero),
        row(CLOSURE_NAMES[1], zero, zero, -gap),
        row(CLOSURE_NAMES[2], third / widen, third, -third),
    )
    spread = result.withColumn("_s", F.explode(rows)).withColumn("gap_to_close", gap).select("*", "_s.*").drop("_s")
    spread = spread.withColumns(
        {n: F.lit(0.0) for n in ("eligible_exceptions_change", "financing_sources_change", "net_borrowing_change")}
    )
    return budget_result(apply_changes(spread))


def gap_structure(result: DataFrame) -> DataFrame:
    """Structural overlap, remainder, and the isolated amounts that would close the gap."""
    gap = F.col("normalization_gap")
    overlap = F.least(F.col("structural_gap"), gap)
    widen = 1.0 + F.col("deficit_limit_ratio")
    return result.withColumns(
        {
            "structural_overlap": overlap,
            "non_structural_remainder": floor_zero(gap - overlap),
            "revenue_base_to_close": F.when(widen > 0, gap / F.when(widen > 0, widen)).otherwise(gap),
            "transfers_to_close": gap,
            "expenditure_cut_to_close": gap,
            "exception_to_close": gap,
        }
    )


def criteria(result: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Five criterion rows per budget with status, value, limit and headroom."""
    c = F.col

    def row(code: str, ok: Column, bad: str, value: Column, limit: Column, headroom: Column) -> Column:
        return F.struct(
            F.lit(code).alias("code"),
            F.lit(CRITERIA_TITLES[code]).alias("title"),
            F.when(ok, "OK").otherwise(bad).alias("status"),
            value.alias("value"),
            limit.alias("limit"),
            headroom.alias("headroom"),
        )

    rows = F.array(
        row(
            "deficit",
            c("normalization_gap") <= 0,
            "BREACH",
            c("deficit_ratio"),
            c("deficit_limit_ratio") + _ratio_or_zero(c("eligible_exceptions"), c("revenue_base")),
            c("allowed_deficit") - c("deficit"),
        ),
        row("structural", c("structural_gap") <= 0, "WATCH", c("recurring_balance"), F.lit(0.0), c("recurring_balance")),
        row("financing", c("financing_gap") <= 0, "WATCH", c("financing_gap"), F.lit(0.0), -c("financing_gap")),
        row(
            "debt", c("debt_within_configured_limit"), "BREACH", c("debt_ratio"), c("debt_limit_ratio"), c("debt_headroom")
        ),
        row(
            "debt_service",
            c("debt_service_within_configured_limit"),
            "BREACH",
            c("debt_service_ratio"),
            c("debt_service_limit_ratio"),
            c("debt_service_limit_ratio") - c("debt_service_ratio"),
        ),
    )
    return result.select(*keys, F.inline(rows))


def components(result: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Ten labelled measures per budget."""
    rows = F.array(*[F.struct(F.lit(label).alias("component"), F.col(c).alias("value")) for label, c in COMPONENTS])
    return result.select(*keys, F.inline(rows))


def plan_arithmetic(plan: DataFrame) -> DataFrame:
    """Calculated deficit and the part its planned financing leaves uncovered."""
    deficit = F.col("expenditure") - F.col("total_revenue")
    return plan.withColumns(
        {
            "calculated_deficit": deficit,
            "uncovered_plan_need": floor_zero(deficit - F.col("financing_sources")),
        }
    )


def reject_reason(rules: Sequence[Rule]) -> Column:
    return first_reason([(r.name, F.coalesce(r.bad, F.lit(False))) for r in rules])
