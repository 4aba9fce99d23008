"""Queries on budget codes: yearly mappings of the classification, amounts carried along, composed paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesora.operators import mapping as mp
from tesora.plans import inputs as data
from tesora.plans.registry import query, rounded, sql_round as r

VERSIONS = [str(y) for y in range(1995, 2001)]


def _codes(spark, sf):
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return data.read(spark, sf, "part").select(brand.alias("b"), F.col("p_type").alias("t")).distinct()


def _code(brand) -> F.Column:
    return F.concat(F.lit("Brand#"), brand.cast("string"), F.lit("/"), F.col("t"))


def mappings(spark, sf):
    """What becomes of every code in every year; the remainder of brand and year picks the relationship."""
    years = F.explode(F.array(*[F.lit(int(v)) for v in VERSIONS])).alias("v")
    base = _codes(spark, sf).select("b", "t", years).withColumn("k", (F.col("b") * 7 + F.col("v")) % 23)
    own, following = _code(F.col("b")), _code(F.col("b") % 25 + 1)
    row = lambda kind, target, share=None: F.struct(F.lit(kind).alias("kind"), target.cast("string").alias("target"), F.lit(share).cast("double").alias("share"))
    none = F.lit(None)
    cases = (
        F.when(F.col("k") == 0, F.array(row("one_to_many", own, 0.6), row("one_to_many", following, 0.4)))
        .when(F.col("k") == 1, F.array(row("many_to_one", _code(F.col("b") - (F.col("b") - 1) % 5))))
        .when(F.col("k") == 2, F.array(row("retired", none)))
        .when(F.col("k") == 3, F.array(row("one_to_one", _code(26 - F.col("b")))))
        .when(F.col("k") == 4, F.array(row("one_to_one", own), row("one_to_one", following)))
        .when(F.col("k") == 5, F.array().cast("array<struct<kind:string,target:string,share:double>>"))
        .when(F.col("k") == 6, F.array(row("one_to_many", own, 0.5), row("one_to_many", following, 0.3)))
        .when(F.col("k") == 7, F.array(row("excluded", none)))
        .otherwise(F.array(row("renamed_same_code", own)))
    )
    rows = base.select("v", own.alias("source_code"), F.explode(cases).alias("c"))
    return rows.select(
        F.col("v").cast("string").alias("mapping_version"),
        F.col("c.kind").alias("relationship"),
        "source_code",
        F.col("c.target").alias("target_code"),
        F.concat(F.lit("C:"), F.coalesce("c.target", "source_code")).alias("canonical_id"),
        F.make_date("v", F.lit(1), F.lit(1)).alias("valid_from"),
        F.make_date("v", F.lit(12), F.lit(31)).alias("valid_to"),
        F.col("c.share").alias("share"),
    )


_C = "'Brand#' || {} || '/' || t"
_OWN, _NEXT = _C.format("b"), _C.format("(b % 25 + 1)")
MAPPINGS_SQL = f"""codes AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS b, p_type AS t FROM part),
base AS (SELECT b, t, v, (b * 7 + v) % 23 AS k, {_OWN} AS source_code FROM codes, generate_series(1995, 2000) g(v)),
mapping AS (
  SELECT v, 'one_to_many' AS kind, source_code, {_OWN} AS target, 0.6 AS share FROM base WHERE k = 0
  UNION ALL SELECT v, 'one_to_many', source_code, {_NEXT}, 0.4 FROM base WHERE k = 0
  UNION ALL SELECT v, 'many_to_one', source_code, {_C.format("(b - (b - 1) % 5)")}, 1.0 FROM base WHERE k = 1
  UNION ALL SELECT v, 'retired', source_code, NULL, 1.0 FROM base WHERE k = 2
  UNION ALL SELECT v, 'one_to_one', source_code, {_C.format("(26 - b)")}, 1.0 FROM base WHERE k = 3
  UNION ALL SELECT v, 'excluded', source_code, NULL, 1.0 FROM base WHERE k = 7
  UNION ALL SELECT v, 'renamed_same_code', source_code, {_OWN}, 1.0 FROM base WHERE k > 7),
faulty AS (SELECT v, source_code, 2 AS rows, CASE k WHEN 4 THEN 'AMBIGUOUS' ELSE 'SHARES_DO_NOT_SUM' END AS reason_code FROM base WHERE k IN (4, 6)),
cut AS (SELECT *, CASE WHEN kind = 'one_to_many' THEN sum(share) OVER (PARTITION BY v, source_code ORDER BY target) - share ELSE 0.0 END::DOUBLE AS low,
  CASE WHEN kind = 'one_to_many' THEN sum(share) OVER (PARTITION BY v, source_code ORDER BY target) ELSE 1.0 END::DOUBLE AS high FROM mapping)"""


def _facts(spark, sf):
    """Shipped value in cents per day and code, one row an item."""
    items = data.read(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    parts = data.read(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("code"))
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return joined.select(F.col("l_shipdate").cast("date").alias("day"), "code", cents.alias("cents"))


_FACTS_SQL = "facts AS (SELECT CAST(l_shipdate AS DATE) AS day, p_brand || '/' || p_type AS code, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("code_mapping_review", f"WITH {MAPPINGS_SQL} SELECT CAST(v AS VARCHAR) AS mapping_version, source_code, reason_code, CAST(rows AS BIGINT) AS n_rows FROM faulty")
def code_mapping_review(spark, sf):
    bad = mp.check_mapping(mappings(spark, sf)).quarantine
    return bad.groupBy("mapping_version", "source_code", "reason_code").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "mapped_budget",
    f"""WITH {MAPPINGS_SQL}, {_FACTS_SQL}
SELECT CAST(v AS INTEGER) AS year, 'C:' || target AS canonical_id, CAST(sum(CAST(floor(cents * high + 0.5) AS BIGINT) - CAST(floor(cents * low + 0.5) AS BIGINT)) AS BIGINT) AS cents,
  count(DISTINCT source_code) AS sources
FROM facts JOIN cut ON code = source_code AND year(day) = v WHERE target IS NOT NULL GROUP BY 1, 2""",
)
def mapped_budget(spark, sf):
    """Every item of the budget under the codes of the following year."""
    checked = mp.check_mapping(mappings(spark, sf)).clean
    moved = mp.apply_mapping(_facts(spark, sf), checked, code="code", on="day", amount="cents").clean
    return moved.groupBy(F.year("day").alias("year"), "canonical_id").agg(F.sum("cents").alias("cents"), F.count_distinct("code").alias("sources"))


@query(
    "mapping_totals",
    f"""WITH {MAPPINGS_SQL}, {_FACTS_SQL},
met AS (SELECT year(day) AS year, cents, CASE WHEN kind IN ('retired', 'excluded') THEN upper(kind) WHEN kind IS NULL THEN 'UNMAPPED' ELSE 'MAPPED' END AS outcome
  FROM facts LEFT JOIN (SELECT DISTINCT v, source_code, kind FROM mapping) ON code = source_code AND year(day) = v)
SELECT CAST(year AS INTEGER) AS year, outcome, CAST(sum(cents) AS BIGINT) AS cents FROM met GROUP BY 1, 2""",
)
def mapping_totals(spark, sf):
    """The budget of a year by what became of it; all outcomes together are the budget before."""
    checked = mp.check_mapping(mappings(spark, sf)).clean
    parts = mp.apply_mapping(_facts(spark, sf), checked, code="code", on="day", amount="cents")
    clean = parts.clean.select("day", "cents", F.lit("MAPPED").alias("outcome"))
    both = clean.unionByName(parts.quarantine.select("day", "cents", F.col("reason_code").alias("outcome")))
    return both.groupBy(F.year("day").alias("year"), "outcome").agg(F.sum("cents").alias("cents"))


_PATHS_SQL = f"""{MAPPINGS_SQL},
paths AS (
  SELECT 1995 AS v, source_code, target, share::DOUBLE AS share, [source_code] AS codes, CASE WHEN target IS NULL THEN upper(kind) END AS status FROM mapping WHERE v = 1995
  UNION ALL
  SELECT p.v + 1, p.source_code, CASE WHEN p.status IS NULL AND m.source_code IS NOT NULL THEN m.target ELSE p.target END,
    CASE WHEN p.status IS NULL AND m.source_code IS NOT NULL THEN p.share * m.share ELSE p.share END,
    CASE WHEN p.status IS NULL AND m.source_code IS NOT NULL THEN list_append(p.codes, p.target) ELSE p.codes END,
    CASE WHEN p.status IS NOT NULL THEN p.status WHEN m.source_code IS NULL THEN 'UNMAPPED' WHEN m.target IS NULL THEN upper(m.kind) END
  FROM paths p LEFT JOIN mapping m ON p.status IS NULL AND m.v = p.v + 1 AND m.source_code = p.target WHERE p.v < 2000),
ended AS (SELECT * REPLACE (coalesce(status, 'FINAL') AS status) FROM paths WHERE v = 2000)"""


def _paths(spark, sf):
    return mp.compose(mp.check_mapping(mappings(spark, sf)).clean, versions=VERSIONS)


@query(
    "code_paths",
    f"WITH RECURSIVE {_PATHS_SQL} SELECT source_code, target AS target_code, {r('share', 9)} AS share, array_to_string(codes, '>') AS codes, status FROM ended",
)
def code_paths(spark, sf):
    """All ways of a code of 1995 through the yearly mappings."""
    out = _paths(spark, sf).select("source_code", "target_code", "share", F.array_join("codes", ">").alias("codes"), "status")
    return rounded(out, 9, "share")


@query(
    "composed_mapping",
    f"""WITH RECURSIVE {_PATHS_SQL},
pairs AS (SELECT source_code, target, sum(share) AS share FROM ended WHERE status = 'FINAL' GROUP BY 1, 2),
counted AS (SELECT *, count(*) OVER (PARTITION BY source_code) AS targets, count(*) OVER (PARTITION BY target) AS sources FROM pairs)
SELECT source_code, target AS target_code, {r("share", 9)} AS share,
  CASE WHEN targets > 1 THEN 'one_to_many' WHEN sources > 1 THEN 'many_to_one' WHEN source_code = target THEN 'renamed_same_code' ELSE 'one_to_one' END AS relationship FROM counted""",
)
def composed_mapping(spark, sf):
    return rounded(mp.relationship_of(_paths(spark, sf)).drop("mapping_version"), 9, "share")


@query(
    "code_chains",
    """WITH RECURSIVE codes AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS b, p_type AS t FROM part),
edges AS (SELECT b, t, CASE WHEN b > 20 THEN NULL ELSE b * b % 23 + 1 END AS n FROM codes WHERE b <> 13),
walk AS (
  SELECT t, b, n, [b] AS codes, CASE WHEN n IS NULL THEN 'RETIRED' END AS status FROM edges
  UNION ALL
  SELECT w.t, w.b, CASE WHEN e.b IS NULL OR e.n = w.n THEN w.n ELSE e.n END, CASE WHEN e.b IS NULL OR e.n = w.n THEN w.codes ELSE list_append(w.codes, w.n) END,
    CASE WHEN e.b IS NULL OR e.n = w.n THEN 'FINAL' WHEN list_contains(list_append(w.codes, w.n), e.n) THEN 'CYCLE' WHEN e.n IS NULL THEN 'RETIRED' END
  FROM walk w LEFT JOIN edges e ON e.t = w.t AND e.b = w.n WHERE w.status IS NULL)
SELECT 'Brand#' || b || '/' || t AS source_code, 'Brand#' || n || '/' || t AS target_code, CAST(len(codes) AS INTEGER) AS hops, status FROM walk WHERE status IS NOT NULL""",
)
def code_chains(spark, sf):
    """Renames within one version, followed to their end; a code that comes back to itself goes to review."""
    b = F.col("b")
    ends = b > 20
    rows = _codes(spark, sf).where(b != 13).select(
        F.lit("2001").alias("mapping_version"),
        F.when(ends, "retired").otherwise("one_to_one").alias("relationship"),
        _code(b).alias("source_code"),
        F.when(~ends, _code(b * b % 23 + 1)).alias("target_code"),
        F.concat(F.lit("C:"), _code(b)).alias("canonical_id"),
        F.lit(None).cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.lit(None).cast("double").alias("share"),
    )
    paths = mp.compose(mp.check_mapping(rows).clean)
    return paths.select("source_code", "target_code", F.size("codes").alias("hops"), "status")
