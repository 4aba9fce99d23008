"""Names to official territory codes: registry, approved aliases, checks and proposals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesora.functions.scalar import code_part, territory_code
from tesora.functions.unicode_names import distinct_name_keys, nfkc_name_key
from tesora.operators.contracts import Split, clean_header, missing_columns, unique_rows

# Registry and alias columns, header aliases, statuses.
REGISTRY_COLUMNS = (
    "oktmo",
    "oktmo_full",
    "municipality_name",
    "municipality_type",
    "region_name",
    "region_code",
    "parent_oktmo",
    "valid_from",
    "valid_to",
    "source_id",
    "source_url",
    "source_version",
    "status",
)
ALIAS_COLUMNS = (
    "source_id",
    "source_municipality_name",
    "oktmo",
    "match_method",
    "status",
    "source_url",
    "notes",
)
HEADER_ALIASES = {
    "ter": ("ter", "тер"),
    "kod1": ("kod1", "код1"),
    "kod2": ("kod2", "код2"),
    "kod3": ("kod3", "код3"),
    "name": ("name1", "name", "наименование", "наименование территории"),
    "change": ("nomakt", "номер изменения", "nom_akt"),
    "status": ("status", "статус", "тип изменения"),
}
APPROVED = ("APPROVED", "VERIFIED")
RESOLVED = "OKTMO_RESOLVED"


def read_registry(df: DataFrame) -> Split:
    """Registry rows with a valid, unique code and a name key; the rest goes aside."""
    missing = missing_columns(df, REGISTRY_COLUMNS)
    if missing:
        raise ValueError("registry columns missing: " + ", ".join(missing))
    df = df.select(*REGISTRY_COLUMNS).withColumn("oktmo", territory_code("oktmo"))
    bad = df.where(F.col("oktmo").isNull()).select("oktmo", F.lit(1).cast("long").alias("n_rows"), F.lit("BAD_CODE").alias("reason_code"))
    parts = unique_rows(df.where(F.col("oktmo").isNotNull()), ["oktmo"])
    keyed = parts.clean.withColumn("name_key", nfkc_name_key("municipality_name"))
    return Split(keyed, bad.unionByName(parts.quarantine))


def read_aliases(df: DataFrame) -> Split:
    missing = missing_columns(df, ALIAS_COLUMNS)
    if missing:
        raise ValueError("alias columns missing: " + ", ".join(missing))
    df = df.select(*ALIAS_COLUMNS).withColumns(
        {"oktmo": territory_code("oktmo"), "name_key": nfkc_name_key("source_municipality_name")}
    )
    return Split(
        df.where(F.col("oktmo").isNotNull()),
        df.where(F.col("oktmo").isNull()).withColumn("reason_code", F.lit("BAD_CODE")),
    )


def approved(aliases: DataFrame) -> DataFrame:
    return aliases.where(F.upper("status").isin(*APPROVED))


def identity_problems(registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases to unknown codes, and approved alias keys leading to several codes."""
    unknown = (
        aliases.join(registry.select("oktmo"), "oktmo", "left_anti")
        .groupBy("oktmo")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("UNKNOWN_CODE").alias("problem"), F.col("oktmo").alias("item"), "n")
    )
    several = (
        approved(aliases)
        .groupBy("source_id", "name_key")
        .agg(F.count_distinct("oktmo").alias("n"))
        .where(F.col("n") > 1)
        .select(
            F.lit("ALIAS_WITH_SEVERAL_CODES").alias("problem"),
            F.concat_ws("|", "source_id", "name_key").alias("item"),
            "n",
        )
    )
    return unknown.unionByName(several)


def resolve_names(
    names: DataFrame, *, name: str, source_id: str, registry: DataFrame, aliases: DataFrame
) -> DataFrame:
    """One row per distinct source name with its official code and name, or the reason why not.

    An alias key with several codes is left unresolved.
    """
    keys = distinct_name_keys(names, name)
    usable = approved(aliases).where(F.col("source_id") == source_id)
    codes = (
        usable.groupBy("name_key")
        .agg(F.min("oktmo").alias("oktmo"), F.max("oktmo").alias("_other"))
        .where(F.col("oktmo") == F.col("_other"))
        .drop("_other")
    )
    known = codes.join(registry.select("oktmo", "municipality_name"), "oktmo")
    joined = keys.join(known, "name_key", "left")
    found = F.col("oktmo").isNotNull()
    return joined.select(
        F.col(name),
        "name_key",
        F.coalesce("oktmo", F.lit("")).alias("oktmo"),
        F.coalesce("municipality_name", F.lit("")).alias("municipality_name"),
        F.when(found, RESOLVED).otherwise("UNRESOLVED").alias("identity_status"),
        F.when(found, "APPROVED_SOURCE_ALIAS").otherwise("NO_APPROVED_OKTMO_ALIAS").alias("identity_reason"),
    )


def propose_aliases(names: DataFrame, *, name: str, source_id: str, registry: DataFrame) -> Split:
    """Exact matches on a name key that is unique in the registry; other names need review."""
    keys = distinct_name_keys(names, name)
    single = (
        registry.groupBy("name_key")
        .agg(F.min("oktmo").alias("oktmo"), F.max("oktmo").alias("_other"))
        .where(F.col("oktmo") == F.col("_other"))
        .drop("_other")
    )
    joined = keys.join(single, "name_key", "left")
    proposed = joined.where(F.col("oktmo").isNotNull()).select(
        F.lit(source_id).alias("source_id"),
        F.col(name).alias("source_municipality_name"),
        "oktmo",
        F.lit("EXACT_UNIQUE_NAME").alias("match_method"),
        F.lit("APPROVED").alias("status"),
    )
    review = joined.where(F.col("oktmo").isNull()).select(
        F.col(name).alias("source_municipality_name"), F.lit("REVIEW_REQUIRED").alias("status")
    )
    return Split(proposed, review)


# ---- registry build ----------------------------------------------------------


def canonical_header(df: DataFrame) -> DataFrame:
    """Known header spellings renamed to canonical fields."""
    wanted = {alias: field for field, names in HEADER_ALIASES.items() for alias in names}
    df = clean_header(df)
    return df.toDF(*[wanted.get(" ".join(c.lower().split()), c) for c in df.columns])


def build_registry(df: DataFrame, *, source_id: str, source_url: str, source_version: str) -> Split:
    """Registry from the parts of the official code list.

    A code with several names goes aside as a conflict; otherwise one row per code.
    """
    df = canonical_header(df)
    missing = missing_columns(df, ("ter", "kod1", "kod2", "name"))
    if missing:
        raise ValueError("code list fields missing: " + ", ".join(missing))
    kod3 = code_part("kod3", 3) if "kod3" in df.columns else F.lit("")
    parts = df.select(
        code_part("ter", 2).alias("ter"),
        code_part("kod1", 3).alias("kod1"),
        code_part("kod2", 3).alias("kod2"),
        kod3.alias("kod3"),
        F.trim(F.coalesce(F.col("name").cast("string"), F.lit(""))).alias("municipality_name"),
    )
    parts = parts.where(
        F.col("ter").rlike("^[0-9]{2}$")
        & F.col("kod1").rlike("^[0-9]{3}$")
        & F.col("kod2").rlike("^[0-9]{3}$")
        & (F.col("municipality_name") != "")
    )
    tail = F.when(F.col("kod3").rlike("^[0-9]{3}$"), F.col("kod3")).otherwise("000")
    coded = parts.select(
        F.concat("ter", "kod1", "kod2").alias("oktmo"),
        F.concat("ter", "kod1", "kod2", tail).alias("oktmo_full"),
        "municipality_name",
        F.col("ter").alias("region_code"),
    )
    per_code = coded.groupBy("oktmo").agg(
        F.min("municipality_name").alias("municipality_name"),
        F.max("municipality_name").alias("other_name"),
        F.min("oktmo_full").alias("oktmo_full"),
        F.first("region_code").alias("region_code"),
    )
    same = F.col("municipality_name") == F.col("other_name")
    blank = F.lit("")
    clean = per_code.where(same).select(
        "oktmo",
        "oktmo_full",
        "municipality_name",
        blank.alias("municipality_type"),
        blank.alias("region_name"),
        "region_code",
        blank.alias("parent_oktmo"),
        blank.alias("valid_from"),
        blank.alias("valid_to"),
        F.lit(source_id).alias("source_id"),
        F.lit(source_url).alias("source_url"),
        F.lit(source_version).alias("source_version"),
        F.lit("ACTIVE").alias("status"),
    )
    conflicts = per_code.where(~same).select(
        "oktmo", "municipality_name", "other_name", F.lit("CONFLICTING_NAMES").alias("reason_code")
    )
    return Split(clean, conflicts)


def conflicting_codes(df: DataFrame, *, code: str = "oktmo", name: str = "municipality_name") -> DataFrame:
    """Codes seen with more than one name."""
    return df.groupBy(code).agg(F.count_distinct(name).alias("names")).where(F.col("names") > 1)


def one_per_code(df: DataFrame, *, code: str = "oktmo", order: Sequence[Column] | None = None) -> DataFrame:
    """First row per code in the given order."""
    by = F.struct(*(order or [F.col(c) for c in df.columns]))
    return df.groupBy(code).agg(F.min_by(F.struct(*df.columns), by).alias("row")).select("row.*")
