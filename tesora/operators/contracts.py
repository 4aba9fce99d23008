"""Row rules: one pass that counts every breach, and splits into clean and quarantined rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesora.functions.scalar import first_reason

ERROR = "ERROR"
WARNING = "WARNING"


@dataclass(frozen=True)
class Rule:
    """``bad`` marks a breaching row; NULL counts as no breach."""

    name: str
    severity: str
    bad: Column


@dataclass(frozen=True)
class Split:
    """``marked``, where an operator has it: all rows of both sides at once, ``reason_code`` null on clean ones."""

    clean: DataFrame
    quarantine: DataFrame
    marked: DataFrame | None = None


def computed_once(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """``withColumns`` for costly values, such as parsed text, that several rules read.

    Spark repeats a plain column's expression wherever a later filter or column
    names it, and filters do so for every rule. Values that come out of a
    generator are computed once a row.
    """
    names = [*df.columns, *[c for c in cols if c not in df.columns]]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    row = F.struct(*[c.alias(name) for name, c in cols.items()])
    return df.select(*rest, F.inline(F.array(row))).select(*[F.col(f"`{c}`") for c in names])


def split(df: DataFrame, rules: Sequence[Rule]) -> Split:
    """Rows without an ERROR breach, and the others with ``reason_code`` of the first breach."""
    reasons = [(r.name, F.coalesce(r.bad, F.lit(False))) for r in rules if r.severity == ERROR]
    marked = df.withColumn("reason_code", first_reason(reasons))
    return Split(
        marked.where(F.col("reason_code").isNull()).drop("reason_code"),
        marked.where(F.col("reason_code").isNotNull()),
        marked,
    )


def enforce(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Strict form of :func:`split`: the job fails on the first breaching row."""
    reasons = [(r.name, F.coalesce(r.bad, F.lit(False))) for r in rules if r.severity == ERROR]
    reason = first_reason(reasons)
    return df.where(F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("rule broken: "), reason))
                           .cast("boolean")).otherwise(F.lit(True)))


def rule_counts(df: DataFrame, rules: Sequence[Rule], totals: Sequence[tuple[str, str, Column]] = ()) -> DataFrame:
    """``(rule, severity, n)``: a single aggregate over the table, unpivoted afterwards.

    ``totals`` adds findings given as aggregates: (name, severity, aggregate).
    """
    found = [(r.name, r.severity, F.count_if(F.coalesce(r.bad, F.lit(False)))) for r in rules] + list(totals)
    if not found:
        return df.sparkSession.createDataFrame([], "rule string, severity string, n long")
    counted = df.agg(*[n.alias(f"r{i}") for i, (_, _, n) in enumerate(found)])
    cells = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col(f"r{i}").alias("n"))
        for i, (name, severity, _) in enumerate(found)
    ])
    return counted.select(F.inline(cells))


def duplicate_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows whose key occurs more than once (all of them are counted)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_keys"))


def unique_rows(df: DataFrame, keys: Sequence[str]) -> Split:
    """Rows whose key is unique, and one row per repeated key with its row count.

    The aggregate collapses repeats before the shuffle, so a key that holds a
    large share of the table never meets in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    payload = F.struct(*rest) if rest else F.struct(F.lit(1).alias("one"))
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.any_value(payload).alias("row"))
    clean = per_key.where(F.col("n_rows") == 1)
    clean = clean.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])
    repeated = per_key.where(F.col("n_rows") > 1).select(*keys, "n_rows", F.lit("DUPLICATE_KEY").alias("reason_code"))
    return Split(clean, repeated)


def require_unique(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """Strict uniqueness: the job fails when a key repeats."""
    rest = [c for c in df.columns if c not in keys]
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.any_value(F.struct(*rest)).alias("row"))
    checked = per_key.where(
        F.when(F.col("n_rows") > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    )
    return checked.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def not_in_set(c: Column, allowed: Sequence[str]) -> Column:
    return c.isNotNull() & ~c.isin(*allowed)


def clean_header(df: DataFrame) -> DataFrame:
    """Column names trimmed and freed of a byte order mark."""
    return df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def fill_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add absent columns of ``schema`` as NULL, keep the rest as it is."""
    present = set(df.columns)
    return df.select(
        *df.columns,
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in present],
    )


def side_by_side(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row tables in one row, without a join."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
