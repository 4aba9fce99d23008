"""Dataset contracts and the one-pass validation report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesora.operators.contracts import (
    ERROR,
    WARNING,
    Rule,
    clean_header,
    duplicate_key_rows,
    missing_columns,
    not_in_set,
    rule_counts,
    side_by_side,
)


@dataclass(frozen=True)
class DatasetContract:
    required: tuple[str, ...]
    optional: tuple[str, ...]
    key: tuple[str, ...]


# Columns and keys of the six datasets.
CONTRACTS = {
    "reference_core": DatasetContract(
        (
            "year",
            "municipality_name",
            "tax_initial",
            "nontax_initial",
            "tax_actual",
            "nontax_actual",
            "program_expense",
            "total_expense",
            "budget_amendments",
            "municipal_debt",
            "own_revenue_base",
        ),
        (),
        ("year", "municipality_name"),
    ),
    "quality_rankings": DatasetContract(
        ("year", "municipality_name", "rank"),
        (
            "article136_high_subsidy_flag",
            "quality_score_workbook_value",
            "budget_law_violation_count",
            "source_file",
            "source_sheet",
        ),
        ("year", "municipality_name"),
    ),
    "budget_provision": DatasetContract(
        ("year", "period", "period_end", "municipality_name", "bo_actual", "bo_calculated"),
        (
            "population",
            "estimated_revenue",
            "estimated_obligations",
            "revenue_shortfall",
            "equalization_support",
            "source_file",
            "source_status",
        ),
        ("year", "period", "municipality_name"),
    ),
    "budget_official_plan": DatasetContract(
        (
            "year",
            "municipality_name",
            "stage",
            "total_revenue",
            "revenue_base",
            "additional_ndfl",
            "legal_deficit_base",
            "transfers",
            "expenditure",
            "deficit",
            "financing_sources",
            "eligible_exceptions",
            "source_url",
            "publication_date",
        ),
        ("debt_upper_limit", "debt_service", "exceptions_status", "source_document", "notes"),
        ("year", "municipality_name", "stage"),
    ),
    "budget_project": DatasetContract(
        ("year", "municipality_name", "budget_side", "group", "item_name", "amount"),
        (
            "item_code",
            "is_transfer",
            "is_recurring",
            "is_subvention",
            "is_debt_service",
            "is_borrowing",
            "flexibility",
            "source_file",
            "notes",
        ),
        ("year", "municipality_name", "budget_side", "group", "item_name"),
    ),
    "external_monthly": DatasetContract(
        (
            "period",
            "geography_name",
            "geography_level",
            "variable",
            "value",
            "unit",
            "source",
            "publication_date",
            "as_of_date",
        ),
        ("source_url", "oktmo", "notes"),
        ("period", "geography_name", "variable"),
    ),
}
PLAN_AMOUNTS = (
    "total_revenue",
    "revenue_base",
    "additional_ndfl",
    "legal_deficit_base",
    "transfers",
    "expenditure",
    "deficit",
    "financing_sources",
    "eligible_exceptions",
)
BUDGET_SIDES = ("REVENUE", "EXPENDITURE", "FINANCING", "EXCEPTION")
FLEXIBILITIES = ("FIXED", "PARTIAL", "FLEXIBLE", "UNKNOWN")
TOLERANCE = 0.001


def _number(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.when(~F.isnan(c.cast("double")), c.cast("double"))
    return c.try_cast("double")


def _date(name: str) -> Column:
    return F.col(name).try_cast("date")


def close_to(expected: Column, given: Column, reference: Column) -> Column:
    """Within 0.1% of the reference amount, at least 0.001; NULL when a side is missing."""
    return F.abs(expected - given) <= F.greatest(F.abs(reference), F.lit(1.0)) * TOLERANCE


def missing_cells(df: DataFrame, columns: Sequence[str]) -> Column:
    """Number of missing cells of a row; a number that is none counts as missing."""
    present = [f for f in df.schema.fields if f.name in columns]
    real = (T.FloatType, T.DoubleType)
    gone = [F.col(f.name).isNull() | F.isnan(f.name) if isinstance(f.dataType, real) else F.col(f.name).isNull() for f in present]
    return reduce(lambda a, b: a + b, [g.cast("long") for g in gone], F.lit(0).cast("long"))


def name_rules(df: DataFrame) -> list[Rule]:
    if "municipality_name" not in df.columns:
        return []
    name = F.trim(F.col("municipality_name").cast("string"))
    return [
        Rule("BLANK_NAME", ERROR, F.coalesce(name == "", F.lit(True))),
        Rule("NUMERIC_NAME", ERROR, name.rlike("^[0-9]+$")),
    ]


def date_rules(df: DataFrame, key: str) -> list[Rule]:
    rules = []
    if "year" in df.columns:
        rules.append(Rule("BAD_YEAR", ERROR, _number(df, "year").isNull()))
    if "period_end" in df.columns:
        rules.append(Rule("BAD_PERIOD_END", ERROR, _date("period_end").isNull()))
    if key == "external_monthly":
        rules += [
            Rule(f"BAD_{c.upper()}", ERROR, _date(c).isNull())
            for c in ("period", "publication_date", "as_of_date")
            if c in df.columns
        ]
        if "value" in df.columns:
            rules.append(Rule("BAD_VALUE", ERROR, _number(df, "value").isNull()))
        if {"publication_date", "as_of_date"} <= set(df.columns):
            rules.append(Rule("AS_OF_BEFORE_PUBLICATION", WARNING, _date("as_of_date") < _date("publication_date")))
    return rules


def amount_rules(df: DataFrame, columns: Sequence[str], severity: str = ERROR, *, parse: bool = True) -> list[Rule]:
    rules = []
    for c in columns:
        if c in df.columns:
            if parse:
                rules.append(Rule(f"BAD_{c.upper()}", severity, _number(df, c).isNull()))
            rules.append(Rule(f"NEGATIVE_{c.upper()}", severity, _number(df, c) < 0))
    return rules


def set_rules(df: DataFrame) -> list[Rule]:
    rules = []
    if "budget_side" in df.columns:
        side = F.upper(F.trim(F.col("budget_side").cast("string")))
        rules.append(Rule("UNKNOWN_SIDE", ERROR, not_in_set(side, BUDGET_SIDES)))
    if "flexibility" in df.columns:
        flex = F.upper(F.trim(F.col("flexibility").cast("string")))
        rules.append(Rule("UNKNOWN_FLEXIBILITY", ERROR, not_in_set(flex, FLEXIBILITIES)))
    return rules


def arithmetic_rules(df: DataFrame, key: str) -> list[Rule]:
    have = set(df.columns)
    rules = []
    n = lambda c: _number(df, c)
    if key == "budget_official_plan":
        if {"total_revenue", "revenue_base", "transfers"} <= have:
            total = n("total_revenue")
            rules.append(Rule("TOTAL_MISMATCH", WARNING, ~close_to(n("revenue_base") + n("transfers"), total, total)))
        if {"total_revenue", "expenditure", "deficit"} <= have:
            gap = n("expenditure") - n("total_revenue")
            want = F.when(gap > 0, gap).when(gap.isNotNull(), 0.0)
            rules.append(Rule("DEFICIT_MISMATCH", WARNING, ~close_to(want, n("deficit"), want)))
    if key == "reference_core":
        if {"program_expense", "total_expense"} <= have:
            rules.append(Rule("PROGRAM_ABOVE_TOTAL", WARNING, n("program_expense") > n("total_expense")))
        rules += amount_rules(df, ("municipal_debt", "own_revenue_base", "total_expense"), WARNING, parse=False)
    if key == "quality_rankings" and "rank" in have:
        rules.append(Rule("RANK_NOT_POSITIVE", WARNING, n("rank") <= 0))
    if key == "budget_provision" and {"estimated_revenue", "estimated_obligations", "revenue_shortfall"} <= have:
        want = n("estimated_obligations") - n("estimated_revenue")
        rules.append(Rule("SHORTFALL_MISMATCH", WARNING, ~close_to(want, n("revenue_shortfall"), want)))
    return rules


def dataset_rules(df: DataFrame, key: str) -> list[Rule]:
    rules = name_rules(df) + date_rules(df, key)
    if key == "budget_official_plan":
        rules += amount_rules(df, PLAN_AMOUNTS)
    if key == "budget_project":
        rules += amount_rules(df, ("amount",)) + set_rules(df)
    return rules + arithmetic_rules(df, key)


def entity_column(df: DataFrame) -> str | None:
    return next((c for c in ("municipality_name", "geography_name") if c in df.columns), None)


def period_label(df: DataFrame) -> Column:
    """Aggregate expression: first to last year, or first to last month."""
    label = F.lit(None).cast("string")

    def span(a: Column, b: Column) -> Column:
        return F.when(a == b, a).otherwise(F.concat(a, F.lit("–"), b))

    if "period" in df.columns:
        lo, hi = (F.date_format(f(_date("period")), "yyyy-MM") for f in (F.min, F.max))
        label = span(lo, hi)
    if "year" in df.columns:
        num = _number(df, "year").cast("int")
        label = F.coalesce(span(F.min(num).cast("string"), F.max(num).cast("string")), label)
    return F.coalesce(label, F.lit("—"))


def validation_report(df: DataFrame, key: str) -> DataFrame:
    """``(rule, severity, n)`` for every rule of a dataset, zero counts included.

    Row rules share one aggregate; repeated keys are a second, pre-aggregated one.
    Column-set findings come from the schema alone.
    """
    spec = CONTRACTS[key]
    df = clean_header(df)
    totals = [
        ("MISSING_REQUIRED_CELL", ERROR, F.coalesce(F.sum(missing_cells(df, spec.required)), F.lit(0))),
        ("EMPTY_TABLE", ERROR, (F.count(F.lit(1)) == 0).cast("long")),
    ]
    report = rule_counts(df, dataset_rules(df, key), totals)
    if all(c in df.columns for c in spec.key):
        dup = duplicate_key_rows(df, spec.key)
        report = report.unionByName(
            dup.select(F.lit("DUPLICATE_KEY").alias("rule"), F.lit(WARNING).alias("severity"), F.col("duplicate_keys").alias("n"))
        )
    known = {*spec.required, *spec.optional}
    shape = [
        ("MISSING_COLUMN", ERROR, len(missing_columns(df, spec.required))),
        ("DUPLICATE_COLUMN", ERROR, len(df.columns) - len(set(df.columns))),
        ("EXTRA_COLUMN", WARNING, len([c for c in df.columns if c not in known])),
    ]
    return report.unionByName(df.sparkSession.createDataFrame(shape, "rule string, severity string, n long"))


def quality(report: DataFrame) -> DataFrame:
    """One row: REJECTED with any error, REVIEW with any warning, otherwise ACCEPTED."""
    found = report.agg(
        F.coalesce(F.sum(F.when(F.col("severity") == ERROR, F.col("n"))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("severity") == WARNING, F.col("n"))), F.lit(0)).alias("warnings"),
    )
    return found.withColumn(
        "quality", F.when(F.col("errors") > 0, "REJECTED").when(F.col("warnings") > 0, "REVIEW").otherwise("ACCEPTED")
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, distinct entities and the period label."""
    df = clean_header(df)
    entity = entity_column(df)
    name = F.nullif(F.trim(F.col(entity).cast("string")), F.lit("")) if entity else F.lit(None).cast("string")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.count_distinct(name).alias("entities"),
        period_label(df).alias("period_label"),
    )


def dataset_status(df: DataFrame | None, key: str, *, uploaded: bool, spark=None) -> DataFrame:
    """Status line of a dataset: mode, rows, entities, period and quality."""
    schema = "dataset_key string, mode string, row_count long, entities long, period_label string, quality string"
    if df is None:
        return spark.createDataFrame([(key, "missing", 0, 0, "—", "MISSING")], schema)
    both = side_by_side(dataset_summary(df), quality(validation_report(df, key)))
    return both.select(
        F.lit(key).alias("dataset_key"),
        F.lit("uploaded" if uploaded else "built_in").alias("mode"),
        "row_count",
        "entities",
        "period_label",
        "quality",
    )
