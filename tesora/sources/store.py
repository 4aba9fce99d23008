"""Record store: every data product as (dataset, municipality, code, period, payload) rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that may carry the name, the code and the period, in order of preference;
# data classes and role limits.
NAME_COLUMNS = ("municipality_name", "geography_name", "object_name")
CODE_COLUMNS = ("oktmo", "municipality_oktmo", "object_oktmo")
PERIOD_COLUMNS = ("period", "year", "report_year")
CLASS_LEVEL = {
    "PUBLIC": 0,
    "INTERNAL": 1,
    "RESTRICTED": 2,
    "BANK_CONFIDENTIAL": 3,
    "HIGHLY_RESTRICTED": 4,
}
ROLE_MAX = {
    "BUSINESS_USER": 1,
    "MODEL_ANALYST": 1,
    "DATA_ENGINEER": 1,
    "AUDITOR": 3,
    "SECURITY_ADMIN": -1,
}
PAGE_LIMIT = 1000


def _first_text(df: DataFrame, names: Sequence[str]) -> Column:
    present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit("")) if present else F.lit("")


def to_records(df: DataFrame, dataset: str, registry: DataFrame | None = None) -> DataFrame:
    """Rows of one product; the code comes from the row, else from the registry by name."""
    payload = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    rows = df.select(
        F.lit(dataset).alias("dataset"),
        _first_text(df, NAME_COLUMNS).alias("municipality"),
        _first_text(df, CODE_COLUMNS).alias("oktmo"),
        _first_text(df, PERIOD_COLUMNS).alias("period"),
        payload.alias("payload"),
    )
    if registry is not None:
        codes = registry.groupBy("municipality_name").agg(F.max("oktmo").alias("_code"))
        rows = rows.join(codes, rows.municipality == codes.municipality_name, "left").select(
            "dataset",
            "municipality",
            F.when(F.col("oktmo") != "", F.col("oktmo")).otherwise(F.coalesce("_code", F.lit(""))).alias("oktmo"),
            "period",
            "payload",
        )
    return rows


def build_records(products: Mapping[str, DataFrame], registry: DataFrame | None = None) -> DataFrame:
    out = None
    for name, df in products.items():
        rows = to_records(df, name, registry)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no products")
    return out


def write_records(records: DataFrame, path: str) -> None:
    """One folder per dataset, rows of a municipality close together, so reads skip the rest.

    The payload hash lets the ranges split even one municipality's period.
    """
    (
        records.repartitionByRange("dataset", "municipality", "period", F.xxhash64("payload"))
        .sortWithinPartitions("dataset", "municipality", "period")
        .write.mode("overwrite")
        .partitionBy("dataset")
        .parquet(path)
    )


def select_records(
    records: DataFrame, *, dataset: str, municipality: str | None = None, period: str | None = None
) -> DataFrame:
    df = records.where(F.col("dataset") == dataset)
    if municipality is not None:
        df = df.where(F.col("municipality") == municipality)
    if period is not None:
        df = df.where(F.col("period") == period)
    return df


def page(df: DataFrame, *, order: Sequence[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """One ordered page. A top-k plan, so only ``limit + offset`` rows leave each task."""
    if not 1 <= limit <= PAGE_LIMIT or offset < 0:
        raise ValueError("limit: 1..1000; offset >= 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def municipalities(records: DataFrame) -> DataFrame:
    """Distinct names with a code, if any row has one, and its identity status."""
    named = records.where(F.col("municipality") != "")
    per = named.groupBy("municipality").agg(F.max(F.nullif("oktmo", F.lit(""))).alias("oktmo"))
    status = F.when(F.col("oktmo").isNull(), "code_missing").otherwise("code_present_requires_verification")
    return per.select(F.col("municipality").alias("name"), "oktmo", status.alias("identity_status"))


def datasets(records: DataFrame) -> DataFrame:
    return records.groupBy("dataset").agg(F.count(F.lit(1)).alias("row_count"))


# ---- visibility --------------------------------------------------------------


def _level(mapping: Mapping[str, int], key: Column, default: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def can_read(role: Column, data_class: Column) -> Column:
    """Role's highest level covers the row's class; unknown classes and roles see nothing."""
    allowed = _level(ROLE_MAX, role, -1) >= _level(CLASS_LEVEL, data_class, 999)
    return F.when(role == "SECURITY_ADMIN", F.lit(False)).otherwise(allowed)


def visible_to(df: DataFrame, role: str, data_class: str = "data_class") -> DataFrame:
    return df.where(can_read(F.lit(role), F.col(data_class)))
