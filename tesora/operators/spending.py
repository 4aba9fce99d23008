"""Raw spending export to the canonical panel with explicit identity."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesora.functions.scalar import month_bounds, parse_number
from tesora.operators.contracts import ERROR, Rule, clean_header, computed_once, missing_columns, side_by_side, split, unique_rows
from tesora.operators.identity import RESOLVED, resolve_names
from tesora.session import materialize

# Export columns, category codes and canonical column order.
EXPORT_COLUMNS = (
    "period",
    "value",
    "obs_status",
    "source",
    "category_15",
    "mo",
    "freq",
    "decimals",
    "unit_measure",
    "unit_mult",
)
CATEGORY_CODES = {
    "Все категории": "ALL",
    "Продовольствие": "FOOD",
    "Здоровье": "HEALTH",
    "Общественное питание": "DINING",
    "Маркетплейсы": "MARKETPLACES",
    "Транспорт": "TRANSPORT",
}
CANONICAL_COLUMNS = (
    "municipality_id",
    "municipality_name",
    "source_municipality_name",
    "oktmo",
    "period_start",
    "period_end",
    "frequency",
    "category",
    "category_code",
    "spending_nominal",
    "data_status",
    "identity_status",
    "model_eligible",
    "source",
    "obs_status",
    "unit",
)
AMBIGUOUS = "AMBIGUOUS_SOURCE_NAME"


@dataclass(frozen=True)
class SpendingTables:
    canonical: DataFrame
    quarantine: DataFrame
    rejected: DataFrame
    profile: DataFrame


def category_code(labels: Mapping[str, str] = CATEGORY_CODES):
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])


def check_export(df: DataFrame, labels: Mapping[str, str] = CATEGORY_CODES):
    """Typed export rows; unusable ones go aside with a reason."""
    df = clean_header(df)
    missing = missing_columns(df, EXPORT_COLUMNS)
    if missing:
        raise ValueError("export columns missing: " + ", ".join(missing))
    value = parse_number("value") if dict(df.dtypes)["value"] == "string" else F.col("value").cast("double")
    df = computed_once(
        df,
        {
            "mo": F.trim("mo"),
            "category_15": F.trim("category_15"),
            "period": F.col("period").try_cast("date"),
            "value": value,
        },
    )
    return split(
        df,
        [
            Rule("BAD_PERIOD", ERROR, F.col("period").isNull()),
            Rule("BAD_VALUE", ERROR, F.col("value").isNull() | F.isnan("value")),
            Rule("BLANK_NAME", ERROR, F.coalesce(F.col("mo"), F.lit("")) == ""),
            Rule("NEGATIVE_VALUE", ERROR, F.col("value") < 0),
            Rule("UNKNOWN_CATEGORY", ERROR, F.col("category_15").isNotNull() & ~F.col("category_15").isin(*labels)),
        ],
    )


def exact_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows, and a one-row table with how many copies were removed."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    removed = counted.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("exact_duplicates_removed"))
    return counted.drop("_copies"), removed


def ambiguous_names(distinct_rows: DataFrame) -> DataFrame:
    """Names that occur twice for one period and category."""
    repeated = distinct_rows.groupBy("period", "category_15", "mo").agg(F.count(F.lit(1)).alias("n"))
    return repeated.where(F.col("n") > 1).select("mo").distinct()


def canonicalize(
    export: DataFrame,
    *,
    registry: DataFrame,
    aliases: DataFrame,
    source_id: str,
    labels: Mapping[str, str] = CATEGORY_CODES,
) -> SpendingTables:
    """Canonical panel, quarantine and profile.

    The per-name table (resolution plus ambiguity) is built from distinct names
    and joined once; Spark broadcasts it when small and splits hot names when not.
    """
    checked = check_export(export, labels)
    # the names, the doubtful ones and the join all start from the distinct rows: the export is read once for them
    rows = materialize(checked.clean.groupBy(*checked.clean.columns).agg(F.count(F.lit(1)).alias("copies")), "spending_rows")
    resolved = resolve_names(rows, name="mo", source_id=source_id, registry=registry, aliases=aliases)
    doubtful = ambiguous_names(rows).withColumn("_twice", F.lit(True))
    names = resolved.join(doubtful, "mo", "left")
    twice = F.coalesce("_twice", F.lit(False))
    names = names.select(
        "mo",
        "oktmo",
        F.col("municipality_name").alias("official_municipality_name"),
        F.when(twice, AMBIGUOUS).otherwise(F.col("identity_status")).alias("identity_status"),
        F.when(twice, "DUPLICATE_PERIOD_CATEGORY_NAME_IN_SOURCE").otherwise(F.col("identity_reason")).alias("identity_reason"),
    )
    # staged once: canonical rows, quarantine and profile are three reads of this table
    joined = materialize(rows.join(names, "mo", "left"), "spending_staged")
    first, last = month_bounds("period")
    good = joined.where(F.col("identity_status") == RESOLVED).select(
        F.col("oktmo").alias("municipality_id"),
        F.col("official_municipality_name").alias("municipality_name"),
        F.col("mo").alias("source_municipality_name"),
        "oktmo",
        first.alias("period_start"),
        last.alias("period_end"),
        F.lit("MONTH").alias("frequency"),
        F.col("category_15").alias("category"),
        F.element_at(category_code(labels), F.col("category_15")).alias("category_code"),
        F.col("value").alias("spending_nominal"),
        F.lit("official_public").alias("data_status"),
        "identity_status",
        F.lit(True).alias("model_eligible"),
        F.col("source").cast("string").alias("source"),
        F.col("obs_status").cast("string").alias("obs_status"),
        F.col("unit_measure").cast("string").alias("unit"),
    )
    # two source names may lead to one code: such keys are refused as a whole
    parts = unique_rows(good, ["oktmo", "category_code", "period_start"])
    canonical = parts.clean.select(*CANONICAL_COLUMNS)
    quarantine = joined.where(F.col("identity_status") != RESOLVED).drop("copies")
    clash = parts.quarantine
    profile = ingest_profile(joined, canonical)
    rejected = checked.quarantine.select(
        F.col("mo"), F.col("category_15"), F.col("period").cast("string").alias("period"), "reason_code"
    ).unionByName(
        clash.select(
            F.col("oktmo").alias("mo"),
            F.col("category_code").alias("category_15"),
            F.col("period_start").cast("string").alias("period"),
            "reason_code",
        )
    )
    return SpendingTables(canonical, quarantine, rejected, profile)


def ingest_profile(staged: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row of counts from two one-row aggregates."""
    open_rows = F.col("identity_status") != RESOLVED
    left = staged.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("exact_duplicates_removed"),
        F.count_if(open_rows).alias("quarantined_rows"),
        F.count_if(F.col("identity_status") == "UNRESOLVED").alias("unresolved_rows"),
        F.count_distinct(F.when(F.col("identity_status") == AMBIGUOUS, F.col("mo"))).alias("ambiguous_names"),
    )
    right = canonical.agg(
        F.count(F.lit(1)).alias("canonical_rows"),
        F.count_distinct("oktmo").alias("municipalities_model_eligible"),
        F.count_distinct("period_start").alias("periods"),
        F.count_distinct("category_code").alias("categories"),
        F.min("period_start").alias("period_start"),
        F.max("period_start").alias("period_end"),
    )
    return side_by_side(left, right)


def peer_panel(export: DataFrame, peers: DataFrame):
    """Rows of allow-listed names with their code; repeated (name, period, category) go aside.

    ``peers``: mo, oktmo with one code per name and one name per code.
    """
    trimmed = peers.select(F.trim("mo").alias("mo"), F.trim("oktmo").alias("oktmo"))
    single = trimmed.groupBy("oktmo").agg(F.min("mo").alias("mo"), F.max("mo").alias("_o")).where(F.col("mo") == F.col("_o"))
    data = export.select(
        F.trim("mo").alias("mo"),
        F.trim("category_15").alias("category_15"),
        F.col("period").try_cast("date").alias("period"),
        F.col("value").cast("double").alias("value"),
    ).join(single.select("mo", "oktmo"), "mo")
    return unique_rows(data, ["mo", "oktmo", "period", "category_15"])
