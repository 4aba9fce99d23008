"""Budget codes over the years: checked mappings, amounts carried to new codes without loss, and composed mappings.

A mapping row says what becomes of a source code within a version and a validity
interval. One source may go to several targets with shares; amounts are whole
cents and are cut at the rounded cumulative shares, so the parts of an amount
always add up to it. What cannot be carried goes to review with a reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import first_reason
from tesora.operators.contracts import Split
from tesora.session import materialize

# Relationships of a mapping row, and those that need a target or must not have one.
RELATIONSHIPS = ("one_to_one", "one_to_many", "many_to_one", "renamed_same_code", "newly_introduced", "retired", "excluded")
CARRIES = ("one_to_one", "one_to_many", "many_to_one", "renamed_same_code")
ENDS = ("retired", "excluded")
KEY = ("mapping_version", "source_code")
_FIRST_DAY, _LAST_DAY = "0001-01-01", "9999-12-31"


def _interval(df: DataFrame) -> DataFrame:
    """Open ends become the first and the last day."""
    return df.withColumns(
        {
            "valid_from": F.coalesce(F.col("valid_from").cast("date"), F.lit(_FIRST_DAY).cast("date")),
            "valid_to": F.coalesce(F.col("valid_to").cast("date"), F.lit(_LAST_DAY).cast("date")),
            "share": F.coalesce(F.col("share").cast("double"), F.when(F.col("relationship") != "one_to_many", 1.0)),
        }
    )


def check_mapping(mapping: DataFrame) -> Split:
    """Rows of usable source codes, and all rows of a source code with a fault, each with the first reason.

    Columns: mapping_version, relationship, source_code, target_code,
    canonical_id, valid_from, valid_to, share. Official rows that contradict each
    other are ambiguous: every row of that source goes to review.
    """
    rows = _interval(mapping)
    kind, target = F.col("relationship"), F.col("target_code")
    per_row = first_reason(
        [
            ("MISSING_KEY", F.col("mapping_version").isNull() | F.col("source_code").isNull() | F.col("canonical_id").isNull()),
            ("UNKNOWN_RELATIONSHIP", F.coalesce(~kind.isin(*RELATIONSHIPS), F.lit(True))),
            ("MISSING_TARGET", kind.isin(*CARRIES) & target.isNull()),
            ("UNEXPECTED_TARGET", kind.isin(*ENDS) & target.isNotNull()),
            ("CODE_CHANGED", (kind == "renamed_same_code") & (target != F.col("source_code"))),
            ("BAD_INTERVAL", F.col("valid_to") < F.col("valid_from")),
            ("BAD_SHARE", F.coalesce((F.col("share") <= 0) | (F.col("share") > 1), F.lit(True))),
        ]
    )
    marked = rows.withColumn("_own", per_row)
    # one row per source and interval; a source has a handful of them
    span = [*KEY, "valid_from", "valid_to"]
    groups = marked.groupBy(*span).agg(
        F.min("_own").alias("own"),
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("target_code").alias("targets"),
        F.sum(F.when(kind == "one_to_many", 1).otherwise(0)).alias("split"),
        F.sum("share").alias("share"),
    )
    along = Window.partitionBy(*KEY).orderBy("valid_from", "valid_to")
    groups = groups.withColumn("_until", F.max("valid_to").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    ambiguous = ((F.col("rows") > 1) & (F.col("split") < F.col("rows"))) | ((F.col("split") > 0) & (F.col("targets") < F.col("rows")))
    reason = first_reason(
        [
            ("OVERLAP", F.col("valid_from") <= F.col("_until")),
            ("AMBIGUOUS", ambiguous),
            ("SHARES_DO_NOT_SUM", (F.col("split") > 0) & (F.abs(F.col("share") - 1) > 1e-9)),
        ]
    )
    faults = groups.withColumn("reason_code", F.coalesce("own", reason)).where("reason_code IS NOT NULL")
    faults = faults.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(F.min_by("reason_code", F.struct("valid_from", "valid_to")).alias("reason_code"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    judged = rows.join(faults, same, "left").drop(*[f"_{k}" for k in KEY])
    return Split(judged.where("reason_code IS NULL").drop("reason_code"), judged.where("reason_code IS NOT NULL"))


def compiled(mapping: DataFrame) -> DataFrame:
    """Checked rows with ``low`` and ``high``: the part of an amount that a target takes, as cumulative shares."""
    span = [*KEY, "relationship", "valid_from", "valid_to"]
    parts = F.sort_array(F.collect_list(F.struct("target_code", "canonical_id", "share")))  # the targets of one source
    held = mapping.groupBy(*span).agg(parts.alias("p"), F.sum("share").alias("_whole"))
    upto = lambda i: F.aggregate(F.slice("p", 1, i), F.lit(0.0), lambda a, x: a + x["share"])
    cut = F.transform(
        "p",
        lambda x, i: F.struct(
            x["target_code"].alias("target_code"),
            x["canonical_id"].alias("canonical_id"),
            x["share"].alias("share"),
            upto(i).alias("low"),
            F.when(i + 1 == F.size("p"), F.lit(1.0)).otherwise(upto(i + 1)).alias("high"),
        ),
    )
    return held.select(*span, F.inline(cut))


def part_of(amount: Column, low: Column, high: Column) -> Column:
    """Whole cents of an amount between two cumulative shares; neighbouring parts share their cut, so nothing is lost."""
    edge = lambda x: F.floor(amount * x + 0.5)
    return edge(high).cast("long") - edge(low).cast("long")


def apply_mapping(facts: DataFrame, mapping: DataFrame, *, code: str, on: str, amount: str) -> Split:
    """Facts with whole-cent amounts carried to the codes of a checked mapping that is valid on their date.

    ``clean`` has the facts' columns with ``target_code``, ``canonical_id`` and
    the part of the amount; ``quarantine`` has the facts that stay behind, with
    ``UNMAPPED`` or the relationship that ends their code in capitals. The sums
    of both parts together equal the sum of the facts. Facts of one code spread
    over tasks: the mapping is the small side, and adaptive skew handling splits
    a hot code when it is not broadcast.
    """
    table = compiled(mapping).select(
        F.col("source_code").alias("_source"), F.col("relationship").alias("_kind"), F.col("valid_from").alias("_from"),
        F.col("valid_to").alias("_to"), "target_code", "canonical_id", F.col("low").alias("_low"), F.col("high").alias("_high"),
    )
    met = facts.join(table, (F.col(code) == F.col("_source")) & F.col(on).between(F.col("_from"), F.col("_to")), "left")
    carried = F.coalesce(F.col("_kind").isin(*CARRIES), F.lit(False))
    rest = [c for c in facts.columns if c != amount]
    clean = met.where(carried).select(*rest, part_of(F.col(amount), F.col("_low"), F.col("_high")).alias(amount), "target_code", "canonical_id")
    behind = met.where(~carried).select(*facts.columns, F.coalesce(F.upper("_kind"), F.lit("UNMAPPED")).alias("reason_code"))
    return Split(clean, behind)


def compose(mapping: DataFrame, *, versions: Sequence[str] | None = None) -> DataFrame:
    """Where every source code ends, with the product of the shares on the way.

    With ``versions`` in order, each maps the codes of its year to those of the
    next one, and paths start at the first. Without, a target that is itself a
    source of the same version is followed until it is not. One join a round; a
    path that meets its own code again ends as ``CYCLE``. A path is
    ``(mapping_version, source_code, target_code, share, codes, status)`` with
    ``FINAL``, ``CYCLE``, ``UNMAPPED`` (the next version lacks the code) or the
    relationship that ended it in capitals.
    """
    edges = compiled(mapping).select("mapping_version", F.col("source_code").alias("_s"), "relationship", "target_code", "share")
    edges = materialize(edges, "mapping_edges")
    start = edges.select(
        "mapping_version", F.col("_s").alias("source_code"), "target_code", "share", F.array("_s").alias("codes"), _status().alias("status")
    )
    rounds = list(versions[1:]) if versions is not None else None
    found = start.where(F.col("mapping_version") == versions[0]) if versions is not None else start
    while True:
        if rounds is not None and not rounds:
            return found.withColumn("status", F.coalesce("status", F.lit("FINAL")))
        step = edges.select("mapping_version", "_s", F.col("target_code").alias("_t"), F.col("share").alias("_share"), _status().alias("_status"))
        on = [F.col("target_code") == F.col("_s"), F.col("status").isNull()]
        if rounds is not None:
            step, on = step.where(F.col("mapping_version") == rounds.pop(0)).drop("mapping_version"), on
            missing = F.lit("UNMAPPED")
        else:
            step, on = step.withColumnRenamed("mapping_version", "_v"), [*on, F.col("mapping_version") == F.col("_v")]
            missing = F.lit("FINAL")
        met = found.join(step, on, "left")
        open_, hit = F.col("status").isNull(), F.col("_s").isNotNull()
        back = F.array_contains(F.concat("codes", F.array("target_code")), F.col("_t")) if rounds is None else F.lit(False)
        same = F.col("_t") == F.col("target_code") if rounds is None else F.lit(False)  # a code that keeps its name is final
        status = F.when(~open_, F.col("status")).when(~hit, missing).when(same, "FINAL").when(F.coalesce(back, F.lit(False)), "CYCLE").otherwise(F.col("_status"))
        moved = open_ & hit & ~F.coalesce(same, F.lit(False))
        found = met.select(
            "mapping_version",
            "source_code",
            F.when(moved, F.col("_t")).otherwise(F.col("target_code")).alias("target_code"),
            F.when(moved, F.col("share") * F.col("_share")).otherwise(F.col("share")).alias("share"),
            F.when(moved, F.concat("codes", F.array("target_code"))).otherwise(F.col("codes")).alias("codes"),
            status.alias("status"),
        )
        found = materialize(found, "mapping_paths")
        if rounds is None and found.where("status IS NULL").isEmpty():
            return found


def _status() -> Column:
    return F.when(F.col("relationship").isin(*ENDS, "newly_introduced") & F.col("target_code").isNull(), F.upper("relationship"))


def relationship_of(paths: DataFrame) -> DataFrame:
    """Composed paths summed per source and target, with the relationship they amount to."""
    final = paths.where("status = 'FINAL'")
    pairs = final.groupBy("mapping_version", "source_code", "target_code").agg(F.sum("share").alias("share"))
    out = pairs.groupBy("mapping_version", "source_code").agg(F.count(F.lit(1)).alias("_targets"))
    into = pairs.groupBy("mapping_version", "target_code").agg(F.count(F.lit(1)).alias("_sources"))
    met = pairs.join(out, ["mapping_version", "source_code"]).join(into, ["mapping_version", "target_code"])
    kind = (
        F.when(F.col("_targets") > 1, "one_to_many")
        .when(F.col("_sources") > 1, "many_to_one")
        .when(F.col("source_code") == F.col("target_code"), "renamed_same_code")
        .otherwise("one_to_one")
    )
    return met.select("mapping_version", "source_code", "target_code", "share", kind.alias("relationship"))
