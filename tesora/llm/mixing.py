"""Sources mixed to target weights over a time-varying curriculum.

Targets: sources in code-point order share a multiple of all words by weight; no
source takes more than ``most`` times its own words, and what it cannot take is
shared by weight among the others (water level, found by sorting the sources by
the level at which they are full).

Order: a source's schedule gives its weight in each phase of training. The
integral of the schedule, as a share of the whole, is the share of the source's
words due by then. A document's words start at some cumulative demand of its
source; inverting the integral there gives the document's training position.
Documents are range-sorted by position.

Documents of a source stand in the order of a hash. Whole passes over a source
come first; of a last pass every document is taken, in order, that still fits
into the words missing then. Rounds find them: in each, the documents no larger
than the gap are summed up in order until one does not fit, which leaves a gap
smaller than that document and so fewer candidates, all of them after it. The
one document whose size is nearest to the words still missing at the end closes
the gap if that brings the source nearer to its target.

Defined results: null texts have size 0 and are never taken; a null source is a
source of its own, the last; an empty table gives no row; repeated rows are
documents of their own (equal ones may be taken a different number of times);
everything is a function of the rows, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesora.llm.base import WORD, documents, staged

WEIGHTS = (5, 2, 1)
#: Weight of a source in each phase of training, by its place in the cycle of weights: early, even, late.
SCHEDULES = ((4, 3, 2, 1), (1, 1, 1, 1), (1, 2, 3, 4))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Adds ``cycle`` (place in the weights) and ``target`` to one row per source (source, source_size).

    ``share`` is the wanted multiple of all words as a fraction. Integers are
    exact up to the one division, so every run gives the same doubles. The
    windows hold one row per source.
    """
    up, down = share
    if up > most * down:
        raise ValueError("the sources cannot give that many words")
    unit = math.lcm(*weights)
    every = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("cycle", (F.row_number().over(every) - 1) % len(weights))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cycle") + 1).cast("long")
    listed = listed.withColumn("w", pick(weights)).withColumn("cap", F.col("source_size") * most)
    listed = listed.withColumn("full_at", F.col("cap") * pick([unit // w for w in weights]))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    spent = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = listed.withColumn("unspent", F.sum("source_size").over(whole) * up - spent * down)
    levels = levels.withColumn("others", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    levels = levels.withColumn("full", exact("cap") * exact("others") * down <= exact("w") * exact("unspent"))
    # the first source that is not full fixes the level for itself and all after it
    place = F.struct("full_at", F.col("source").isNull().alias("last"), "source", "unspent", "others")
    first = F.min(F.when(~F.col("full"), place)).over(whole)
    levels = levels.withColumn("level", first)
    level = F.col("w").cast("double") * F.col("level.unspent").cast("double") / (F.col("level.others").cast("double") * down)
    return levels.select(
        "source", "source_size", "cycle", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level).alias("target")
    )


def _digits(rows: int) -> int:
    """Hexadecimal digits of the order key that make about as many pieces as a piece has rows."""
    return max(2, math.ceil(math.log(max(rows, 1), 256)))


def _running(sized: DataFrame, by: str, digits: int, ties: Sequence[str] = (), below: str | None = None) -> DataFrame:
    """Adds ``run``: words of the group ``by`` before the document, without one task holding a whole source.

    Keys are cut into pieces by their first digits. With ``below``, a column of
    the group, pieces that start at that many words or more are left out.
    """
    cut = sized.withColumn("piece", F.substring("key", 1, digits))
    limit = [] if below is None else [F.first(below).alias("limit")]
    sums = cut.groupBy(by, "piece").agg(F.sum("size").alias("words"), *limit)
    earlier = Window.partitionBy(by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("carried", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    if below is not None:
        carried = carried.where("carried < limit")
    carried = carried.select(F.col(by).alias("s"), F.col("piece").alias("p"), "carried")
    joined = cut.join(carried, F.col(by).eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
    inside = Window.partitionBy(by, "piece").orderBy("key", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return joined.withColumn("run", own + F.col("carried")).drop("carried", "piece", "s", "p")


def _last_pass(placed: DataFrame, wanted: DataFrame, digits: int) -> DataFrame:
    """(of, at, tail) of the documents of the last pass: source, start, and words of the pass before the document.

    ``gaps`` has one row per source: words missing, words filled, and the place
    of the first document that did not fit, after which all candidates stand.
    """
    gaps = staged(wanted.select("of", F.col("rest").alias("gap"), F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("after")), "mix_gaps")
    body = placed.where("size > 0").select("source", "key", "size", "start")
    found = []
    while gaps.where("gap > 0 and after is not null").limit(1).count():
        open_ = gaps.where("gap > 0 and after is not null")
        small = body.join(open_, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") <= F.col("gap")) & (F.col("start") >= F.col("after")))
        tried = _running(small, "of", digits, ["start"], below="gap").where("run < gap")
        tried = tried.select("of", "start", "size", "run", (F.col("filled") + F.col("run")).alias("tail"), (F.col("run") + F.col("size") <= F.col("gap")).alias("fits"))
        tried = staged(tried, "mix_round")
        found.append(tried.where("fits").select("of", F.col("start").alias("at"), "tail"))
        # sums grow along the order, so what fits is a prefix of the candidates
        ends = tried.groupBy(F.col("of").alias("end_of")).agg(
            F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("more"), F.min(F.when(~F.col("fits"), F.col("start"))).alias("next")
        )
        both = gaps.join(ends, F.col("of").eqNullSafe(F.col("end_of")), "left")
        more = F.coalesce("more", F.lit(0))
        gaps = staged(both.select("of", (F.col("gap") - more).alias("gap"), (F.col("filled") + more).alias("filled"), F.col("next").alias("after")), "mix_gaps")
    # no rows, from a table: rows of the driver would start Python workers
    picked = gaps.where(F.lit(False)).select("of", F.col("gap").alias("at"), F.col("filled").alias("tail"))
    for rows in found:
        picked = picked.unionByName(rows)
    # whatever is left and no larger than twice the gap brings the source nearer; all that is left is larger than the gap
    near = body.join(gaps, F.col("source").eqNullSafe(F.col("of")) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    near = near.join(picked.withColumnRenamed("of", "p"), F.col("of").eqNullSafe(F.col("p")) & (F.col("start") == F.col("at")), "left_anti")
    best = near.groupBy("of").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "key", "start")).alias("best"), F.first("filled").alias("tail"))
    return picked.unionByName(best.select("of", F.col("best.start").alias("at"), "tail"))


def position_sql(cycle: str, x: str, schedules: Sequence[Sequence[int]] = SCHEDULES) -> str:
    """Training time in [0, 1] by which the share ``x`` of a source's words is due (SQL text)."""
    cases = []
    for i, schedule in enumerate(schedules):
        total, done, arms = sum(schedule), 0, []
        for phase, weight in enumerate(schedule):
            if weight:
                inside = f"({phase} + ({x} * {total} - {done}) / {weight}) / {len(schedule)}"
                arms.append(f"WHEN {x} * {total} <= {done + weight} THEN {inside}")
            done += weight
        cases.append(f"WHEN {cycle} = {i} THEN CASE {' '.join(arms)} ELSE 1.0 END")
    return f"CASE {' '.join(cases)} END"


def planned(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[int]] = SCHEDULES,
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    extra: Sequence[str] = (),
) -> DataFrame:
    """:func:`mix` with ``key`` and ``start``: the order hash, and the words of the source before the document."""
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))).alias("key"),
        *extra,
    )
    sized = staged(sized, "mix_sizes")
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    wanted = wanted.withColumn("aim", F.floor("target")).withColumn("passes", F.coalesce(F.floor(F.col("aim") / F.col("source_size")), F.lit(0)))
    wanted = wanted.withColumn("passes", F.least(F.col("passes"), F.lit(most)))
    wanted = wanted.withColumn("rest", F.col("aim") - F.col("passes") * F.col("source_size"))
    wanted = staged(wanted, "mix_targets").withColumnRenamed("source", "of")
    digits = _digits(sized.count())
    placed = staged(_running(sized, "source", digits, extra).withColumnRenamed("run", "start"), "mix_places")
    picked = _last_pass(placed, wanted, digits).withColumnRenamed("of", "from")
    marked = placed.join(wanted, F.col("source").eqNullSafe(F.col("of")))
    chosen = marked.join(picked, F.col("source").eqNullSafe(F.col("from")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("at").isNotNull().cast("long")).otherwise(0)
    out = chosen.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    due = "CASE WHEN p < passes THEN p * source_size + start ELSE passes * source_size + tail END"
    times = f"transform(sequence(0, copies - 1), p -> round({position_sql('cycle', f'least(({due}) / target, 1.0D)', schedules)}, 9))"
    out = out.withColumn("positions", F.when(F.col("copies") > 0, F.expr(times)))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "positions", "key", "start", *extra)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[int]] = SCHEDULES,
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Every document (doc_id, source, text) with size, source_size, target, taken, copies, positions.

    ``positions`` has the training time of each copy; null if the document is
    not taken. ``extra`` columns are carried along.
    """
    return planned(docs, weights, schedules, share, most, extra).drop("key", "start")


def in_order(plan: DataFrame) -> DataFrame:
    """The mix itself, written: one row per copy with its ``position``, range-sorted by it.

    Copies due at one time stand in the order of the hash; documents the mix
    leaves out stand behind it, one row each.
    """
    copies = plan.withColumn("position", F.explode_outer("positions")).drop("positions")
    order = [F.col("position").asc_nulls_last(), F.col("key"), F.col("source").asc_nulls_last(), F.col("start")]
    return staged(copies.repartitionByRange(*order).sortWithinPartitions(*order), "mix_ordered")


def curriculum(docs: DataFrame) -> DataFrame:
    """The mixed documents with all their columns, one row per copy, range-sorted by training position."""
    columns = docs.columns
    body = docs.withColumn("__row", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))))
    plan = staged(mix(body, extra=["__row"]).select("__row", "copies", "positions"), "mix_plan")
    rows = plan.groupBy("__row").agg(F.count("*").alias("__rows"))
    times = plan.select("__row", F.explode("positions").alias("__at")).join(rows, "__row")
    once = body.join(times.where("__rows = 1"), "__row")
    equal = body.join(rows.where("__rows > 1").select("__row"), "__row", "left_semi").dropDuplicates(["__row"])
    again = equal.join(times.where("__rows > 1"), "__row")
    ordered = once.unionByName(again).repartitionByRange("__at", "__row").sortWithinPartitions("__at", "__row")
    return ordered.select(*[F.col(f"`{c}`") for c in columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document by the copies of it that stand in the written mix."""
    mixed = in_order(planned(documents(spark, sf_dir).select("doc_id", "source", "text")))
    # no two documents with words start at the same word of a source, so these two name a taken one
    found = mixed.where("position IS NOT NULL").groupBy("source", "start").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("size").alias("taken"), F.min("position").alias("position")
    )
    left = mixed.where("position IS NULL").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "position")
    return found.select(left.columns).unionByName(left)


OP10_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ' ', coalesce(text, ''))) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS cycle
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE cycle WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources
), ordered AS (
  SELECT *, 3 * sum(source_size) OVER () AS due,
         coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others,
         row_number() OVER o AS place
  FROM weighed WINDOW o AS (ORDER BY source_size * 10 // w, source ASC NULLS LAST)
), levels AS (
  SELECT *, 2 * source_size * others * 2 <= w * (due - 2 * spent) AS is_full FROM ordered
), level AS (
  SELECT min_by(due - 2 * spent, place) AS unspent, min_by(others, place) AS others FROM levels WHERE NOT is_full
), wanted AS (
  SELECT source, source_size, cycle,
         CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(w AS DOUBLE) * CAST(level.unspent AS DOUBLE) / (CAST(level.others AS DOUBLE) * 2) END AS target
  FROM levels LEFT JOIN level ON true
), aims AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS aim,
         CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target) AS BIGINT) // source_size, 2) END AS passes FROM wanted
), placed AS (
  SELECT d.*, a.source_size, a.cycle, a.target, a.passes, a.aim - a.passes * a.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source
), queue AS (
  SELECT source, start, size, key, row_number() OVER (PARTITION BY source ORDER BY start) AS n FROM placed WHERE size > 0
), walk AS (
  SELECT source, CAST(0 AS BIGINT) AS n, CAST(aim - passes * source_size AS BIGINT) AS gap, false AS fits FROM aims
  UNION ALL
  SELECT w.source, q.n, CAST(w.gap - CASE WHEN q.size <= w.gap THEN q.size ELSE 0 END AS BIGINT), q.size <= w.gap
  FROM walk w JOIN queue q ON q.source IS NOT DISTINCT FROM w.source AND q.n = w.n + 1
), tried AS (
  SELECT q.*, w.fits, min(w.gap) OVER (PARTITION BY q.source) AS missing, w.gap
  FROM queue q JOIN walk w ON q.source IS NOT DISTINCT FROM w.source AND q.n = w.n
), closing AS (
  SELECT source, min_by(start, (abs(size - missing), key, start)) AS closing
  FROM tried WHERE NOT fits AND abs(size - missing) < missing GROUP BY source
), chosen AS (
  SELECT p.*, p.rest - CASE WHEN t.fits THEN t.gap + t.size ELSE t.missing END AS tail,
         coalesce(t.fits, false) AS fits, coalesce(p.size > 0 AND p.start = c.closing, false) AS closes
  FROM placed p LEFT JOIN tried t ON p.source IS NOT DISTINCT FROM t.source AND p.start = t.start AND p.size > 0
  LEFT JOIN closing c ON p.source IS NOT DISTINCT FROM c.source
), counted AS (
  SELECT *, CASE WHEN size > 0 THEN passes + CAST(fits OR closes AS INT) ELSE 0 END AS copies,
         least(CAST(CASE WHEN passes > 0 THEN start ELSE tail END AS DOUBLE) / nullif(target, 0), 1.0) AS x
  FROM chosen
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN round({position_sql("cycle", "x")}, 9) END AS position
FROM counted
"""
