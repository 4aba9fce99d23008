"""Publication-date discipline, cumulative snapshots and external series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import first_reason, parse_number
from tesora.operators.contracts import ERROR, Rule, Split, missing_columns, require_unique, split

# Compatibility keys, external columns, categories of public aggregates.
COMPATIBILITY_KEYS = (
    "municipality_id",
    "indicator",
    "method_version",
    "classification_version",
    "scope",
    "unit",
)
EXTERNAL_COLUMNS = (
    "period",
    "geography_name",
    "geography_level",
    "variable",
    "value",
    "unit",
    "source",
    "publication_date",
    "as_of_date",
)
AGGREGATE_CATEGORIES = ("all", "food", "transport", "import_dependent")
AGGREGATE_KEY = ("source", "oktmo", "period", "category", "indicator")
AGGREGATE_COLUMNS = (
    "oktmo",
    "period",
    "category",
    "indicator",
    "value",
    "unit",
    "source",
    "available_at",
    "is_estimated",
)


def asof_violations(df: DataFrame, cutoff: Column | str, publication: str = "publication_date") -> DataFrame:
    """Rows published after the cut-off (a date or a column). A missing date passes."""
    limit = F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff
    return df.where(F.col(publication).cast("date") > limit)


def assert_asof(df: DataFrame, cutoff: Column | str, publication: str = "publication_date") -> DataFrame:
    """Strict form: the job fails on a row published after the cut-off."""
    limit = F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff
    late = F.coalesce(F.col(publication).cast("date") > limit, F.lit(False))
    return df.where(F.when(late, F.raise_error(F.lit("published after the cut-off")).cast("boolean")).otherwise(True))


def published_before_seen(publication: str = "publication_date", as_of: str = "as_of_date") -> Rule:
    """Leak rule: an as-of date earlier than the publication."""
    return Rule("AS_OF_BEFORE_PUBLICATION", "WARNING", F.col(as_of) < F.col(publication))


def ytd_to_flow(
    df: DataFrame,
    *,
    series: Sequence[str] = ("municipality_id", "indicator"),
    period_end: str = "period_end",
    value: str = "value",
    compatibility: Sequence[str] = COMPATIBILITY_KEYS,
    unique: bool = False,
) -> DataFrame:
    """Flow between consecutive snapshots of a year when all compatibility keys agree.

    One snapshot per series and date (checked unless ``unique``), so a partition
    is bounded by the calendar.
    """
    if not unique:
        df = require_unique(df, [*series, period_end], "snapshot date repeats")
    by = Window.partitionBy(*series).orderBy(period_end)
    prior = F.lag(F.struct(F.year(period_end).alias("y"), F.col(value).alias("v"), *compatibility), 1).over(by)
    df = df.withColumn("_p", prior)
    same_year = F.coalesce(F.col("_p.y") == F.year(period_end), F.lit(False))
    same_keys = F.lit(True)
    for k in compatibility:
        same_keys = same_keys & F.col(f"_p.{k}").eqNullSafe(F.col(k))
    return df.withColumns(
        {
            "flow_derived": F.when(same_year & same_keys, F.col(value) - F.col("_p.v")),
            "flow_derivation_status": F.when(~same_year, "no_prior_snapshot")
            .when(same_keys, "derived")
            .otherwise("incompatible_snapshot"),
        }
    ).drop("_p")


# ---- external series ---------------------------------------------------------


def normalize_external(df: DataFrame) -> Split:
    missing = missing_columns(df, EXTERNAL_COLUMNS)
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    value = parse_number("value") if dict(df.dtypes)["value"] == "string" else F.col("value").cast("double")
    typed = df.withColumns(
        {
            **{c: F.col(c).try_cast("date") for c in ("period", "publication_date", "as_of_date")},
            "value": value,
            "geography_name": F.trim("geography_name"),
            "variable": F.trim("variable"),
        }
    )
    return split(
        typed,
        [Rule(f"BAD_{c.upper()}", ERROR, F.col(c).isNull()) for c in ("period", "publication_date", "as_of_date", "value")],
    )


def coverage(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("geography_name").alias("geographies"),
        F.count_distinct("variable").alias("variables"),
        F.date_format(F.min("period"), "yyyy-MM-dd").alias("start_period"),
        F.date_format(F.max("period"), "yyyy-MM-dd").alias("end_period"),
    )


def extract_series(df: DataFrame, *, geography: str, variable: str) -> DataFrame:
    picked = df.where((F.col("geography_name") == geography) & (F.col("variable") == variable))
    return picked.select("period", "value", "unit", "source", "publication_date", "as_of_date")


# ---- public aggregates -------------------------------------------------------


def mark_aggregates(df: DataFrame, *, within: Sequence[str] = ()) -> DataFrame:
    """Rows with ``reason_code`` by the contract of public aggregates; NULL for good ones.

    Row rules come first, then the five-column key: every row of a repeated key
    is marked (``within`` columns belong to the key). Only keys are counted
    apart, so rows of a hot key are counted before they move.
    """
    extra = [c for c in df.columns if c not in (*AGGREGATE_COLUMNS, *within)]
    if extra:
        raise ValueError("columns outside the contract: " + ", ".join(extra))
    reasons = [
        ("BAD_CODE", F.coalesce(~F.col("oktmo").rlike("^[0-9]{8}([0-9]{3})?$"), F.lit(True))),
        ("BAD_VALUE", F.coalesce(F.col("value") < 0, F.lit(True)) | F.isnan("value")),
        ("UNKNOWN_CATEGORY", F.coalesce(~F.col("category").isin(*AGGREGATE_CATEGORIES), F.lit(True))),
        ("RELEASE_BEFORE_PERIOD", F.coalesce(F.col("available_at") < F.col("period"), F.lit(True))),
        ("MISSING_CELL", F.col("indicator").isNull() | F.col("unit").isNull() | F.col("source").isNull() | F.col("period").isNull()),
    ]
    marked = df.withColumn("reason_code", first_reason(reasons))
    key = [*within, *AGGREGATE_KEY]
    good = marked.where(F.col("reason_code").isNull())
    repeats = good.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    joined = marked.join(repeats, key, "left")
    twice = F.when(F.col("reason_code").isNull() & F.col("_n").isNotNull(), "DUPLICATE_KEY")
    return joined.select(*df.columns, F.coalesce("reason_code", twice).alias("reason_code"))


def check_aggregates(df: DataFrame) -> Split:
    """:func:`mark_aggregates` as a split."""
    marked = mark_aggregates(df)
    return Split(
        marked.where(F.col("reason_code").isNull()).drop("reason_code"), marked.where(F.col("reason_code").isNotNull())
    )


def features_as_of(df: DataFrame, prediction_date: str, *, mode: str = "all") -> Split:
    """Rows available by the prediction date, stamped with it.

    ``all`` keeps one-period keys and sets aside keys with several periods (they
    are not unique once the period column is gone); ``latest`` keeps the newest
    period of each key instead.
    """
    when = F.lit(prediction_date).cast("timestamp_ntz")
    key = ["oktmo", "category", "indicator", "source"]
    seen = df.where(F.col("available_at") <= when)
    newest = seen.groupBy(*key).agg(
        F.max_by(F.struct("available_at", "value"), F.col("period")).alias("row"), F.count(F.lit(1)).alias("n_rows")
    )
    out = newest.select(
        "oktmo", when.alias("prediction_date"), "row.available_at", "category", "indicator", "row.value", "source", "n_rows"
    )
    if mode == "latest":
        return Split(out.drop("n_rows"), out.where(F.lit(False)))
    return Split(out.where(F.col("n_rows") == 1).drop("n_rows"), out.where(F.col("n_rows") > 1))
