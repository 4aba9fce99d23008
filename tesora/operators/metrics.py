"""Quality of scores and alarms over the whole population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesora.functions.scalar import safe_ratio
from tesora.operators.prefix import cut_at, running, running_by_value, split_points_of
from tesora.session import materialize, shuffle_width


def point_errors(df: DataFrame, *, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """WAPE and RMSE per group; NULL when the denominator is zero."""
    a, p = F.col(actual), F.col(predicted)
    return df.groupBy(*keys).agg(
        safe_ratio(F.sum(F.abs(a - p)), F.sum(F.abs(a))).alias("wape"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
    )


def scaled_error(
    df: DataFrame, *, keys: Sequence[str], period: str, actual: str, predicted: str, insample: Column, seasonality: int = 1
) -> DataFrame:
    """MASE with a seasonal lag. ``insample`` marks history rows, the rest is scored.

    NULL (with ``status``) when the history is too short or flat.
    """
    by = Window.partitionBy(*keys).orderBy(period)
    hist = F.when(insample, F.col(actual))
    rows = df.select(
        *keys,
        F.abs(hist - F.lag(hist, seasonality).over(by)).alias("step"),
        hist.alias("h"),
        F.when(~insample, F.abs(F.col(actual) - F.col(predicted))).alias("err"),
    )
    flat = rows.groupBy(*keys).agg(
        F.count("h").alias("history"), F.avg("step").alias("scale"), F.avg("err").alias("mae")
    )
    short = F.col("history") <= seasonality
    return flat.select(
        *keys,
        F.when(~short, safe_ratio("mae", "scale")).alias("mase"),
        F.when(short, "SHORT_HISTORY").when(F.col("scale") == 0, "FLAT_HISTORY").otherwise("OK").alias("status"),
    )


def precision_recall(df: DataFrame, *, keys: Sequence[str], truth: str, alarm: str) -> DataFrame:
    """Both are 0 when undefined."""
    y, p = F.col(truth), F.col(alarm)
    tp = F.count_if((y == 1) & (p == 1))
    fp = F.count_if((y == 0) & (p == 1))
    fn = F.count_if((y == 1) & (p == 0))
    return df.groupBy(*keys).agg(
        F.coalesce(safe_ratio(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(safe_ratio(tp, tp + fn), F.lit(0.0)).alias("recall"),
    )


def roc_auc(df: DataFrame, *, keys: Sequence[str], truth: str, score: str, pieces: int | None = None) -> DataFrame:
    """Area under the ROC curve with mid-ranks for ties; NULL without both classes."""
    y = F.col(truth)
    run = running_by_value(
        df,
        keys,
        score,
        {"pos": (y == 1).cast("long"), "neg": (y == 0).cast("long")},
        pieces=pieces,
    )
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    return run.groupBy(*keys).agg(
        safe_ratio(F.sum(won), F.max("pos_total").cast("double") * F.max("neg_total")).alias("roc_auc"),
        F.max("pos_total").alias("positives"),
        F.max("neg_total").alias("negatives"),
    )


def average_precision(
    df: DataFrame, *, keys: Sequence[str], truth: str, score: str, seq: str, pieces: int | None = None
) -> DataFrame:
    """Average precision, descending score, ties in the order of ``seq``.

    Rows are cut into cells by score and by ranges of ``seq`` (a score shared by
    a third of the rows still spreads over many cells). Cell totals give each
    cell's starting counts; ranks inside a cell come from a window. The four
    columns needed are written once and all passes read them.
    """
    pieces = pieces or shuffle_width(df.sparkSession)
    data = df.select(*keys, F.col(truth).alias("y"), (-F.col(score)).alias("s"), F.col(seq).alias("q"))
    data = materialize(data, "scored")
    seq_points, score_points = split_points_of(data, ["q", "s"], pieces)
    data = cut_at(cut_at(data, "q", seq_points, "qb"), "s", score_points, "sb")
    cells = data.groupBy(*keys, "sb", "s", "qb").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("tp")
    )
    bands = cells.groupBy(*keys, "sb").agg(F.sum("n").alias("bn"), F.sum("tp").alias("btp"))
    before_band = Window.partitionBy(*keys).orderBy("sb").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(
        *keys,
        "sb",
        F.coalesce(F.sum("bn").over(before_band), F.lit(0)).alias("bn0"),
        F.coalesce(F.sum("btp").over(before_band), F.lit(0)).alias("btp0"),
        F.sum("btp").over(Window.partitionBy(*keys)).alias("positives"),
    )
    before_cell = Window.partitionBy(*keys, "sb").orderBy("s", "qb").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *keys,
        "sb",
        "s",
        "qb",
        F.coalesce(F.sum("n").over(before_cell), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("tp").over(before_cell), F.lit(0)).alias("tp0"),
    )
    starts = cells.join(bands, [*keys, "sb"]).select(
        *keys, "s", "qb", (F.col("n0") + F.col("bn0")).alias("n0"), (F.col("tp0") + F.col("btp0")).alias("tp0"), "positives"
    )
    inside = Window.partitionBy(*keys, "s", "qb").orderBy("q")
    ranked = data.select(
        *keys,
        "s",
        "qb",
        "y",
        F.row_number().over(inside).alias("k"),
        F.sum((F.col("y") == 1).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"),
    ).where(F.col("y") == 1)
    joined = ranked.join(starts, [*keys, "s", "qb"])
    precision = (F.col("tp0") + F.col("tp")) / (F.col("n0") + F.col("k"))
    return joined.groupBy(*keys).agg(
        safe_ratio(F.sum(precision), F.max("positives")).alias("average_precision"),
        F.max("positives").alias("positives"),
    )


def dual_value(
    df: DataFrame, *, truth: str, reference: str, predictive: str, dual: str, seq: str, pieces: int | None = None
) -> DataFrame:
    """ROC and PR areas of three scores, and the gain of the fused one over the better single one."""
    scores = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("contour"), F.col(c).cast("double").alias("score"))
                for n, c in (("reference", reference), ("predictive", predictive), ("dual", dual))
            ]
        )
    )
    long = df.select(F.col(truth).alias("y"), F.col(seq).alias("seq"), scores.alias("x")).select("y", "seq", "x.*")
    long = materialize(long, "contour_scores")  # the scores' source is read once
    auc = roc_auc(long, keys=["contour"], truth="y", score="score", pieces=pieces)
    ap = average_precision(long, keys=["contour"], truth="y", score="score", seq="seq", pieces=pieces)

    def pick(column: str, contour: str) -> Column:
        return F.max(F.when(F.col("contour") == contour, F.col(column)))

    out = []
    for short, column in (("roc_auc", "roc_auc"), ("pr_auc", "average_precision")):
        r, p, d = (pick(column, c) for c in ("reference", "predictive", "dual"))
        out += [
            r.alias(f"{short}_reference"),
            p.alias(f"{short}_predictive"),
            d.alias(f"{short}_dual"),
            (d - F.greatest(r, p)).alias(f"delta_{short}"),
        ]
    return auc.join(ap.drop("positives"), "contour").agg(*out)


def lead_time_days(signal: Column | str, confirmation: Column | str) -> Column:
    signal = F.col(signal) if isinstance(signal, str) else signal
    confirmation = F.col(confirmation) if isinstance(confirmation, str) else confirmation
    return F.date_diff(confirmation.cast("date"), signal.cast("date"))


def false_alarms_per_unit(df: DataFrame, *, entity: str, year: str, alarm: str, truth: str) -> DataFrame:
    """False alarms per entity and year. Units are collapsed first, then counted."""
    wrong = (F.col(alarm) == 1) & (F.col(truth) == 0)
    units = df.groupBy(entity, year).agg(F.count_if(wrong).alias("fp"))
    total = units.agg(F.coalesce(F.sum("fp"), F.lit(0)).alias("false_alarms"), F.count(F.lit(1)).alias("units"))
    return total.withColumn(
        "false_alarms_per_entity_year", F.coalesce(safe_ratio("false_alarms", "units"), F.lit(0.0))
    )


# ---- averages over territories -----------------------------------------------


def asof_weight(
    df: DataFrame, weights: DataFrame, *, keys: Sequence[str], period: str, at: str, weight: str, block: str | None = None, pieces=None
) -> DataFrame:
    """Every row with the latest weight of its key that is not after its period; null where none is known yet.

    Rows and weights stand in one line per key and the last weight seen is
    carried along, so no row is paired with all weights of its key. Among
    weights of one date the largest counts; null weights and null dates do not.
    With ``block`` a key's line is cut into pieces first (``pieces`` is
    :func:`tesora.operators.prefix.cut_series` or another cut by keys and
    ``_at``), for keys with very many rows.
    """
    known = weights.where(F.col(weight).isNotNull() & F.col(at).isNotNull())
    known = known.select(*keys, F.col(at).cast("date").alias("_day"), F.col(weight).cast("double").alias("_w"))
    facts = df.select(*keys, F.col(period).cast("date").alias("_day"), F.struct(*df.columns).alias("_row"))
    line = known.unionByName(facts, allowMissingColumns=True)
    # weights come first among equal days; rows of one day see the same weight
    line = line.withColumn("_at", F.struct("_day", F.col("_row").isNotNull().alias("late")))
    line = line if block is None else pieces(line)
    seen = F.when(F.col("_w").isNotNull(), F.struct("_day", "_w"))
    out = running(line, {"_last": ("max", seen)}, keys=keys, order="_at", block=block)
    return out.where(F.col("_row").isNotNull()).select("_row.*", F.col("_last._w").alias(weight))


def averages(df: DataFrame, *, by: Sequence[str], metrics: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Macro mean of each metric and its mean under each weight; rows without a metric or a weight do not enter that mean.

    ``(by, rows, <metric>_macro, <metric>_<weight>)``.
    """
    out = [F.count(F.lit(1)).alias("rows")]
    for m in metrics:
        out.append(F.avg(m).alias(f"{m}_macro"))
        for w in weights:
            used = F.when(F.col(m).isNotNull(), F.col(w))
            out.append(safe_ratio(F.sum(F.col(m) * F.col(w)), F.sum(used)).alias(f"{m}_{w}"))
    return df.groupBy(*by).agg(*out)
