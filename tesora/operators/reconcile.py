"""Agreement of two sources, differences of two versions, and row-count gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesora.functions.scalar import safe_ratio
from tesora.operators.contracts import unique_rows
from tesora.operators.forecast import keep_last

COMPARABLE = ("frequency", "unit", "measure")


def published(df: DataFrame, as_of: str) -> DataFrame:
    return df.where(F.col("available_at").cast("date") <= F.lit(as_of).cast("date"))


def reconcile(
    left: DataFrame, right: DataFrame, *, as_of: str, threshold: float = 0.7, min_periods: int = 8
) -> DataFrame:
    """Correlation of two published series per territory.

    A side constant within the overlap, or fewer than ``min_periods`` common
    periods, is insufficient. A territory with a repeated period or with
    different frequency, unit or measure is reported instead of compared.
    """
    if not 0 <= threshold <= 1 or min_periods < 3:
        raise ValueError("threshold must be in [0, 1] and min_periods at least 3")
    sides, doubtful = [], []
    for df in (left, right):
        seen = published(df, as_of).select("period", "oktmo", F.col("value").cast("double").alias("value"), *COMPARABLE)
        parts = unique_rows(seen, ["period", "oktmo"])
        sides.append(parts.clean)
        doubtful.append(parts.quarantine.select("oktmo").distinct())
    a, b = sides
    joined = a.alias("a").join(b.alias("b"), ["period", "oktmo"])
    same = F.lit(True)
    for c in COMPARABLE:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    x, y = F.col("a.value"), F.col("b.value")
    flat = joined.groupBy("oktmo").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.min(x) != F.max(x)) & (F.min(y) != F.max(y))).alias("_varies"),
        # not corr(): it divides by zero on a constant side under ANSI rules
        safe_ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("_corr"),
        F.min(same).alias("_same"),
    )
    repeated = doubtful[0].unionByName(doubtful[1]).distinct().withColumn("_repeated", F.lit(True))
    flat = flat.join(repeated, "oktmo", "full_outer")
    ok = F.coalesce(F.col("_same"), F.lit(True)) & F.col("_repeated").isNull()
    corr = F.when(ok & (F.col("n") >= min_periods) & F.col("_varies"), F.col("_corr"))
    return flat.select(
        "oktmo",
        F.coalesce("n", F.lit(0)).alias("n"),
        corr.alias("correlation"),
        F.when(F.col("_repeated").isNotNull(), "duplicate_period")
        .when(~ok, "not_comparable")
        .when(corr.isNull(), "insufficient")
        .when(corr >= threshold, "consistent")
        .otherwise("inconsistent")
        .alias("status"),
    )


def _signature(df: DataFrame, name: str, digits: int = 12) -> Column:
    """Comparable text of a cell: floats to twelve significant digits, text trimmed."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(None)).otherwise(F.format_string(f"%.{digits - 1}e", c.cast("double")))
    return F.trim(c.cast("string"))


def table_diff(before: DataFrame, after: DataFrame, *, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key with ADDED, REMOVED, CHANGED or SAME; the last row of a key counts.

    Columns only one side has are ignored, as are the sequence numbers.
    """
    common = sorted((set(before.columns) & set(after.columns)) - set(keys) - {seq})

    def side(df: DataFrame, mark: str) -> DataFrame:
        last = keep_last(df, keys, seq)
        return last.select(*keys, F.struct(F.lit(1).alias("_"), *[_signature(last, c).alias(c) for c in common]).alias(mark))

    joined = side(before, "_b").join(side(after, "_a"), list(keys), "full_outer")
    state = (
        F.when(F.col("_b").isNull(), "ADDED")
        .when(F.col("_a").isNull(), "REMOVED")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "SAME")
        .otherwise("CHANGED")
    )
    return joined.select(*keys, state.alias("change"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Numbers of added, removed, changed and unchanged keys."""
    return diff.agg(
        *[F.count_if(F.col("change") == s.upper()).alias(f"{s}_keys") for s in ("added", "removed", "changed", "same")]
    )


def affected_entities(diff: DataFrame, entity: str) -> DataFrame:
    return diff.where(F.col("change") != "SAME").select(entity).distinct()


def keys_missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the left table the right one lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def file_set_diff(listed: DataFrame, found: DataFrame, *, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Missing, changed and unlisted files of a manifest against a directory."""
    a = listed.select(F.col(path), F.col(digest).alias("_want"))
    b = found.select(F.col(path), F.col(digest).alias("_have"))
    state = (
        F.when(F.col("_have").isNull(), "missing")
        .when(F.col("_want").isNull(), "unlisted")
        .when(F.col("_want") != F.col("_have"), "changed")
    )
    return a.join(b, path, "full_outer").select(path, state.alias("state")).where(F.col("state").isNotNull())


def row_count_gate(before: DataFrame, after: DataFrame, *, table: str = "table_name", n: str = "rows", ratio: float = 0.8):
    """Guarded tables with old and new row counts; a table that lost too many is rejected."""
    a = before.select(table, F.col(n).alias("rows_before"))
    b = after.select(table, F.col(n).alias("rows_after"))
    joined = a.join(b, table, "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
    lost = (F.col("rows_before") > 0) & (F.col("rows_after") < F.col("rows_before") * ratio)
    return joined.withColumn("rejected", lost)
