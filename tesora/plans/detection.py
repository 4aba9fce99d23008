"""Queries on alarms, states, thresholds and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesora.functions import scalar as S
from tesora.operators import bocpd
from tesora.operators import detect as dt
from tesora.operators import knots as kn
from tesora.operators import metrics as mt
from tesora.operators import prefix as px
from tesora.operators import resample as rs
from tesora.operators import significance as sg
from tesora.operators.pelt import pelt_breaks
from tesora.plans import inputs as data
from tesora.plans.forecasting import _resampled_sql
from tesora.plans.registry import query, rounded, sql_round as r

KEYS = ["oktmo", "category_code"]
ORDER = {"order": "period_start", "value": "spending_nominal"}
_W = "(PARTITION BY oktmo, category_code ORDER BY period_start)"
_ALL = "(PARTITION BY oktmo, category_code)"


def _z_sql(level: str, warmup: int = 12, source: str = "panel", name: str = "z") -> str:
    return f"""{name}0 AS (SELECT *, row_number() OVER {_W} - 1 AS pos FROM {source}),
{name}1 AS (SELECT *, avg(CASE WHEN pos < {warmup} THEN spending_nominal END) OVER {_ALL} AS mu,
  stddev_pop(CASE WHEN pos < {warmup} THEN spending_nominal END) OVER {_ALL} AS sd FROM {name}0),
{name} AS (SELECT * EXCLUDE (mu, sd), (spending_nominal - mu) / coalesce(nullif(sd, 0), 1) AS z FROM {name}1)"""


def _cusum_sql(threshold: float, drift: float = 0.5, warmup: int = 12, source: str = "z", name: str = "cusum") -> str:
    return f"""{name}0 AS (SELECT *, sum(CASE WHEN pos >= {warmup} THEN z - {drift} ELSE 0 END) OVER {_W} AS s,
  sum(CASE WHEN pos >= {warmup} THEN z + {drift} ELSE 0 END) OVER {_W} AS u FROM {source}),
{name}1 AS (SELECT *, s - least(0, min(s) OVER {_W}) AS cusum_up, u - greatest(0, max(u) OVER {_W}) AS cusum_down FROM {name}0),
{name} AS (SELECT *, pos >= {warmup} AND (cusum_up > {threshold} OR abs(cusum_down) > {threshold}) AS cusum_flag FROM {name}1)"""


def _ph_sql(threshold: float, delta: float = 0.05, warmup: int = 12) -> str:
    return f"""ph0 AS (SELECT *, z - avg(z) OVER {_W} AS d FROM z),
ph1 AS (SELECT *, sum(CASE WHEN pos >= {warmup} THEN d - {delta} ELSE 0 END) OVER {_W} AS p,
  sum(CASE WHEN pos >= {warmup} THEN -d - {delta} ELSE 0 END) OVER {_W} AS q FROM ph0),
ph2 AS (SELECT *, p - least(0, min(p) OVER {_W}) AS ph_up, q - least(0, min(q) OVER {_W}) AS ph_down FROM ph1),
ph AS (SELECT *, pos >= {warmup} AND (ph_up > {threshold} OR ph_down > {threshold}) AS page_hinkley_flag FROM ph2)"""


def _pelt_sql(penalties, source: str = "panel", value: str = "spending_nominal", name: str = "pelt") -> str:
    """The offline search as plain dynamic programming over its grid of five, without pruning."""
    listed = ", ".join(f"({float(p)}::DOUBLE)" for p in penalties)
    by = "oktmo, category_code"
    return f"""{name}_x AS (SELECT {by}, {value} AS x, row_number() OVER (PARTITION BY {by} ORDER BY period_start) - 1 AS p, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
{name}_d AS (SELECT {by}, a.n, a.p AS i, b.p AS j, (a.x - b.x) * (a.x - b.x) AS d FROM {name}_x a JOIN {name}_x b USING ({by})),
{name}_s AS (SELECT {by}, median(d) AS scale FROM {name}_d WHERE i < j GROUP BY ALL),
{name}_k AS (SELECT {by}, n, i // 5 AS bi, j // 5 AS bj,
  sum(CASE WHEN i = j THEN 1.0 ELSE exp(-least(greatest(CASE WHEN scale > 0 THEN d / scale ELSE d END, 0.01), 100)) END) AS k FROM {name}_d JOIN {name}_s USING ({by}) GROUP BY ALL),
{name}_e AS (SELECT DISTINCT {by}, n, least(e, n) AS e FROM (SELECT DISTINCT {by}, n FROM {name}_x WHERE p = 0 AND n >= 4), generate_series(5, n + 4, 5) g(e)),
{name}_c AS (SELECT e.oktmo, e.category_code, e.n, e.e, s.s, sum(k) AS mass
  FROM {name}_e e JOIN (SELECT DISTINCT {by}, bi * 5 AS s FROM {name}_k) s ON s.oktmo = e.oktmo AND s.category_code = e.category_code AND s.s <= e.e - 2 AND (s.s % 5 = 0)
  JOIN {name}_k k ON k.oktmo = e.oktmo AND k.category_code = e.category_code AND k.bi * 5 >= s.s AND k.bj * 5 >= s.s AND k.bi * 5 < e.e AND k.bj * 5 < e.e GROUP BY ALL),
{name}_l AS (SELECT {by}, n, e, (e + 4) // 5 AS step, list(e - s - mass / (e - s) ORDER BY s) AS costs FROM {name}_c GROUP BY ALL),
{name}_r AS (
  SELECT DISTINCT {by}, n, penalty, CAST(0 AS BIGINT) AS step, [0.0::DOUBLE] AS best, [CAST(-1 AS BIGINT)] AS came FROM {name}_e, (VALUES {listed}) q(penalty)
  UNION ALL
  SELECT {by}, n, penalty, t.step, list_append(best, list_min(t.total) + penalty), list_append(came, CAST(list_position(t.total, list_min(t.total)) - 1 AS BIGINT))
  FROM (SELECT r.oktmo, r.category_code, r.n, r.penalty, l.step, r.best, r.came, list_transform(range(1, len(l.costs) + 1), lambda i: r.best[i] + l.costs[i]) AS total
        FROM {name}_r r JOIN {name}_l l ON l.oktmo = r.oktmo AND l.category_code = r.category_code AND l.step = r.step + 1) t),
{name}_f AS (SELECT {by}, penalty, came, step AS node FROM {name}_r WHERE step = (n + 4) // 5
  UNION ALL SELECT {by}, penalty, came, came[node + 1] AS node FROM {name}_f WHERE came[node + 1] > 0),
{name} AS (SELECT {by}, penalty, CAST(came[node + 1] * 5 AS INTEGER) AS break_pos FROM {name}_f WHERE came[node + 1] > 0)"""


def _cusum(spark, sf, level, threshold=5.0):
    return dt.cusum(data.panel(spark, sf, level), keys=KEYS, **ORDER, threshold=threshold)


def _pelt(spark, sf, penalties=(1.0,)):
    return pelt_breaks(data.panel(spark, sf, "nation"), keys=KEYS, order="period_start", value="spending_nominal", penalties=penalties)


def _page_hinkley(spark, sf, level, threshold=8.0):
    z = dt.baseline_standardize(data.panel(spark, sf, level), keys=KEYS, **ORDER).drop("pos")
    return dt.page_hinkley(z, keys=KEYS, order="period_start", value="z", threshold=threshold)


@query(
    "cusum_flags",
    f"""WITH {data.panel_sql('nation')}, {_z_sql('nation')}, {_cusum_sql(5.0)}
SELECT oktmo, category_code, period_start, {r("z", 7)} AS z, {r("cusum_up", 6)} AS cusum_up, {r("cusum_down", 6)} AS cusum_down, cusum_flag
FROM cusum""",
)
def cusum_flags(spark, sf):
    df = _cusum(spark, sf, "nation").drop("pos", "spending_nominal")
    return rounded(rounded(df, 7, "z"), 6, "cusum_up", "cusum_down")


@query(
    "cusum_alarms",
    f"""WITH {data.panel_sql('region')}, {_z_sql('region')}, {_cusum_sql(5.0)}
SELECT oktmo, category_code, CAST(min(pos) FILTER (cusum_flag) AS INTEGER) AS first_alarm FROM cusum GROUP BY 1, 2""",
)
def cusum_alarms(spark, sf):
    return dt.first_alarm(_cusum(spark, sf, "region"), keys=KEYS, flag="cusum_flag")


@query(
    "page_hinkley_flags",
    f"""WITH {data.panel_sql('nation')}, {_z_sql('nation')}, {_ph_sql(8.0)}
SELECT oktmo, category_code, period_start, {r("ph_up", 6)} AS ph_up, {r("ph_down", 6)} AS ph_down, page_hinkley_flag FROM ph""",
)
def page_hinkley_flags(spark, sf):
    df = _page_hinkley(spark, sf, "nation").drop("pos", "spending_nominal", "z")
    return rounded(df, 6, "ph_up", "ph_down")


@query(
    "page_hinkley_alarms",
    f"""WITH {data.panel_sql('region')}, {_z_sql('region')}, {_ph_sql(8.0)}
SELECT oktmo, category_code, CAST(min(pos) FILTER (page_hinkley_flag) AS INTEGER) AS first_alarm FROM ph GROUP BY 1, 2""",
)
def page_hinkley_alarms(spark, sf):
    return dt.first_alarm(_page_hinkley(spark, sf, "region"), keys=KEYS, flag="page_hinkley_flag")


def _run_length_sql(level: str, hazard: str = "1 / 24.0") -> str:
    """The posterior without pruning: densities of each point after each run from prefix sums, then a recursion over lists."""
    by = "oktmo, category_code"
    return f"""{data.panel_sql(level)}, {_z_sql(level)},
rl_p AS (SELECT {by}, pos, z, sum(z) OVER w AS s1, sum(z * z) OVER w AS s2 FROM z WINDOW w AS (PARTITION BY {by} ORDER BY pos)),
rl_q AS (SELECT {by}, pos, z, coalesce(lag(s1) OVER w, 0) AS s1, coalesce(lag(s2) OVER w, 0) AS s2 FROM rl_p WINDOW w AS (PARTITION BY {by} ORDER BY pos)),
rl_n AS (SELECT {by}, a.pos, a.z, a.pos - b.pos AS n, a.s1 - b.s1 AS t1, a.s2 - b.s2 AS t2 FROM rl_q a JOIN rl_q b USING ({by}) WHERE b.pos <= a.pos),
rl_m AS (SELECT *, t1 / (1 + n) AS centre, 1 + n / 2.0 AS shape,
  1 + CASE WHEN n > 0 THEN (t2 - t1 * t1 / n) / 2 + t1 * t1 / n / (2 * (1 + n)) ELSE 0 END AS rate FROM rl_n),
rl_d AS (SELECT {by}, pos, n, lgamma(shape + 0.5) - lgamma(shape) - 0.5 * ln(2 * pi() * shape * v) - (shape + 0.5) * ln(1 + (z - centre) ** 2 / (2 * shape * v)) AS f
  FROM (SELECT *, rate * (n + 2) / (shape * (n + 1)) AS v FROM rl_m)),
rl_l AS (SELECT {by}, pos, list(exp(f) ORDER BY n) AS f FROM rl_d GROUP BY ALL),
rl AS (
  SELECT DISTINCT {by}, CAST(-1 AS BIGINT) AS pos, [1.0::DOUBLE] AS p, 0.0::DOUBLE AS evidence FROM z
  UNION ALL
  SELECT {by}, pos, list_prepend({hazard}, list_transform(joint, lambda j: j * scale)), -ln(scale / (1 - {hazard}))
  FROM (SELECT *, (1 - {hazard}) / list_sum(joint) AS scale FROM (SELECT l.oktmo, l.category_code, l.pos, list_transform(range(1, len(l.f) + 1), lambda i: l.f[i] * rl.p[i]) AS joint
    FROM rl JOIN rl_l l ON l.oktmo = rl.oktmo AND l.category_code = rl.category_code AND l.pos = rl.pos + 1))),
run_lengths AS (SELECT {by}, pos, list_position(p, list_max(p)) - 1 AS run_length, list_sum(p[1:4]) AS p_recent, evidence AS log_predictive FROM rl WHERE pos >= 0)"""


@query(
    "run_lengths",
    f"""WITH RECURSIVE {_run_length_sql("nation")}
SELECT oktmo, category_code, period_start, CAST(run_length AS BIGINT) AS run_length, {r("p_recent", 5)} AS p_recent, {r("log_predictive", 5)} AS log_predictive,
  pos >= 12 AND p_recent > 0.5 AS bocpd_flag FROM run_lengths JOIN z USING (oktmo, category_code, pos)""",
)
def run_lengths(spark, sf):
    """The second online method of the detection protocol, on standardised values."""
    z = dt.baseline_standardize(data.panel(spark, sf, "nation"), keys=KEYS, **ORDER).drop("pos")
    out = bocpd.run_lengths(z, keys=KEYS, order="period_start", value="z")
    return rounded(out.select(*KEYS, "period_start", "run_length", "p_recent", "log_predictive", "bocpd_flag"), 5, "p_recent", "log_predictive")


@query(
    "run_length_alarms",
    f"""WITH RECURSIVE {_run_length_sql("region")}
SELECT oktmo, category_code, CAST(min(pos) FILTER (pos >= 12 AND p_recent > 0.5) AS BIGINT) AS first_alarm FROM run_lengths GROUP BY 1, 2""",
)
def run_length_alarms(spark, sf):
    z = dt.baseline_standardize(data.panel(spark, sf, "region"), keys=KEYS, **ORDER).drop("pos")
    return dt.first_alarm(bocpd.run_lengths(z, keys=KEYS, order="period_start", value="z"), keys=KEYS, flag="bocpd_flag")


# ---- knots: all sets of them, weighted; with levels alone the sum has an SQL form ----


def _knots_sql(level: str, hazard: str = "1 / 24.0", scale: float = 3.0, shape: float = 1.0, rate: float = 0.5) -> str:
    """Segment evidences from prefix sums, then the recursion over lists forwards, and backwards over the same lists by start."""
    by = "oktmo, category_code"
    return f"""{data.panel_sql(level)},
kn_x AS (SELECT {by}, period_start, row_number() OVER (PARTITION BY {by} ORDER BY period_start) AS pos, count(*) OVER (PARTITION BY {by}) AS n,
  (spending_nominal - avg(spending_nominal) OVER (PARTITION BY {by})) / coalesce(nullif(stddev_pop(spending_nominal) OVER (PARTITION BY {by}), 0), 1) AS y FROM panel),
kn_p AS (SELECT {by}, pos, sum(y) OVER w AS s1, sum(y * y) OVER w AS s2 FROM kn_x WINDOW w AS (PARTITION BY {by} ORDER BY pos)
  UNION ALL SELECT DISTINCT {by}, CAST(0 AS BIGINT), 0.0, 0.0 FROM kn_x),
kn_s AS (SELECT {by}, a.pos AS s, b.pos AS e, b.pos - a.pos AS m, b.s1 - a.s1 AS t1, b.s2 - a.s2 AS t2 FROM kn_p a JOIN kn_p b USING ({by}) WHERE a.pos < b.pos),
kn_f AS (SELECT {by}, s, e, exp(lgamma({shape} + m / 2.0) - lgamma({shape}) + {shape} * ln({rate}) - m / 2.0 * ln(2 * pi()) - 0.5 * ln(1 + {scale**2} * m)
  - ({shape} + m / 2.0) * ln({rate} + greatest(t2 - t1 * t1 / (m + 1 / {scale**2}), 0) / 2) + (m - 1) * ln(1 - {hazard}) + CASE WHEN s > 0 THEN ln({hazard}) ELSE 0 END) AS f FROM kn_s),
kn_e AS (SELECT {by}, e, list(f ORDER BY s) AS f FROM kn_f GROUP BY ALL),
kn_b AS (SELECT {by}, s, list(f ORDER BY e) AS f FROM kn_f GROUP BY ALL),
kn_fw AS (SELECT DISTINCT {by}, n, CAST(0 AS BIGINT) AS e, [1.0::DOUBLE] AS p FROM kn_x
  UNION ALL SELECT w.oktmo, w.category_code, w.n, l.e, list_append(w.p, list_sum(list_transform(range(1, len(l.f) + 1), lambda i: l.f[i] * w.p[i])))
  FROM kn_fw w JOIN kn_e l ON l.oktmo = w.oktmo AND l.category_code = w.category_code AND l.e = w.e + 1),
kn_bw AS (SELECT DISTINCT {by}, n AS s, [1.0::DOUBLE] AS p FROM kn_x
  UNION ALL SELECT w.oktmo, w.category_code, l.s, list_prepend(list_sum(list_transform(range(1, len(l.f) + 1), lambda i: l.f[i] * w.p[i])), w.p)
  FROM kn_bw w JOIN kn_b l ON l.oktmo = w.oktmo AND l.category_code = w.category_code AND l.s = w.s - 1),
kn AS (SELECT {by}, x.period_start, CASE WHEN x.pos = 1 THEN 0 ELSE a.p[x.pos] * b.p[x.pos] / a.p[x.n + 1] END AS p_knot, ln(a.p[x.n + 1]) AS log_evidence
  FROM kn_x x JOIN kn_fw a USING ({by}) JOIN kn_bw b USING ({by}) WHERE a.e = x.n AND b.s = 0)"""


LEVELS = kn.KnotModel(structures=("level",))


@query(
    "level_knots",
    f"""WITH RECURSIVE {_knots_sql("nation")}
SELECT oktmo, category_code, period_start, {r("p_knot", 5)} AS p_knot, {r("log_evidence", 4)} AS log_evidence FROM kn""",
)
def level_knots(spark, sf):
    found = kn.knots(data.panel(spark, sf, "nation"), keys=KEYS, **ORDER, model=LEVELS)
    return rounded(rounded(found.drop("p_slope", "p_season"), 5, "p_knot"), 4, "log_evidence")


@query(
    "level_knot_counts",
    f"""WITH RECURSIVE {_knots_sql("region")}
SELECT oktmo, category_code, {r("sum(p_knot)", 4)} AS expected_knots, count(*) FILTER (p_knot >= 0.5) AS n_knots, {r("max(p_knot)", 5)} AS top_p,
  arg_min(period_start, (-round(p_knot, 9), period_start)) AS top_at FROM kn GROUP BY 1, 2""",
)
def level_knot_counts(spark, sf):
    found = kn.knots(data.panel(spark, sf, "region"), keys=KEYS, **ORDER, model=LEVELS)
    return rounded(rounded(kn.knot_alarms(found, keys=KEYS, order="period_start"), 4, "expected_knots"), 5, "top_p")


@query("trend_season_knots")
def trend_season_knots(spark, sf):
    """All four structures; tested against the sum over all knot sets."""
    found = kn.knots(data.panel(spark, sf, "nation"), keys=KEYS, **ORDER)
    return rounded(found, 5, "p_knot", "p_slope", "p_season", "log_evidence")


@query(
    "robust_scores",
    f"""WITH {data.panel_sql('nation')},
med AS (SELECT oktmo, category_code, median(spending_nominal) AS m, stddev_pop(spending_nominal) AS sd FROM panel GROUP BY 1, 2),
mad AS (SELECT oktmo, category_code, median(abs(spending_nominal - m)) AS mad FROM panel JOIN med USING (oktmo, category_code) GROUP BY 1, 2)
SELECT oktmo, category_code, period_start, spending_nominal,
  {r("(spending_nominal - m) / coalesce(nullif(1.4826 * mad, 0), nullif(sd, 0), 1)", 8)} AS z
FROM panel JOIN med USING (oktmo, category_code) JOIN mad USING (oktmo, category_code)""",
)
def robust_scores(spark, sf):
    return rounded(dt.robust_standardize(data.panel(spark, sf, "nation"), keys=KEYS, value="spending_nominal"), 8, "z")


# ---- long series: five event types share all events, so each is cut into pieces ----

_EVENT_Z_SQL = """e0 AS (SELECT event_type, ts, value, row_number() OVER w - 1 AS pos FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
e1 AS (SELECT *, avg(CASE WHEN pos < 12 THEN value END) OVER (PARTITION BY event_type) AS mu, stddev_pop(CASE WHEN pos < 12 THEN value END) OVER (PARTITION BY event_type) AS sd FROM e0),
e AS (SELECT event_type, ts, pos, value, (value - mu) / coalesce(nullif(sd, 0), 1) AS z FROM e1)"""
_EW = "(PARTITION BY event_type ORDER BY ts)"


#: Times may repeat; the id makes the order of a series a function of its rows.
_EVENT_ORDER = ["ts", "event_id"]


def _event_series(spark, sf):
    return px.cut_series(data.read(spark, sf, "events").select("event_type", *_EVENT_ORDER, "value"), ["event_type"], _EVENT_ORDER)


@query(
    "event_cusum",
    f"""WITH {_EVENT_Z_SQL}, s AS (SELECT *, sum(CASE WHEN pos >= 12 THEN z - 0.5 ELSE 0 END) OVER {_EW} AS s, sum(CASE WHEN pos >= 12 THEN z + 0.5 ELSE 0 END) OVER {_EW} AS u FROM e),
m AS (SELECT *, s - least(0, min(s) OVER {_EW}) AS up, u - greatest(0, max(u) OVER {_EW}) AS down FROM s)
SELECT event_type, ts, {r("z", 7)} AS z, {r("up", 5)} AS cusum_up, {r("down", 5)} AS cusum_down, pos >= 12 AND (up > 20 OR abs(down) > 20) AS cusum_flag FROM m""",
)
def event_cusum(spark, sf):
    df = dt.cusum(_event_series(spark, sf), keys=["event_type"], order=_EVENT_ORDER, value="value", threshold=20.0, block="piece")
    return rounded(rounded(df.drop("piece", "pos", "value", "event_id"), 7, "z"), 5, "cusum_up", "cusum_down")


@query(
    "event_page_hinkley",
    f"""WITH {_EVENT_Z_SQL}, d AS (SELECT *, value - avg(value) OVER {_EW} AS d FROM e),
s AS (SELECT *, sum(CASE WHEN pos >= 12 THEN d - 0.05 ELSE 0 END) OVER {_EW} AS p, sum(CASE WHEN pos >= 12 THEN -d - 0.05 ELSE 0 END) OVER {_EW} AS q FROM d)
SELECT event_type, ts, {r(f"p - least(0, min(p) OVER {_EW})", 4)} AS ph_up, {r(f"q - least(0, min(q) OVER {_EW})", 4)} AS ph_down FROM s""",
)
def event_page_hinkley(spark, sf):
    df = dt.page_hinkley(_event_series(spark, sf), keys=["event_type"], order=_EVENT_ORDER, value="value", block="piece")
    return rounded(df.select("event_type", "ts", "ph_up", "ph_down"), 4, "ph_up", "ph_down")


@query(
    "event_states",
    f"""WITH {_EVENT_Z_SQL}, i AS (SELECT event_type, ts, pos, abs(z) AS score, CASE WHEN value > 50 THEN 2 ELSE 1 END AS conf FROM e),
a AS (SELECT *, sum(CASE WHEN score >= 2 THEN 1 ELSE 0 END) OVER {_EW} AS na, max(CASE WHEN score < 1 THEN pos END) OVER {_EW} AS lb, max(CASE WHEN score >= 1 THEN pos END) OVER {_EW} AS lnb FROM i),
b AS (SELECT *, na - coalesce(max(CASE WHEN score < 1 THEN na END) OVER {_EW}, 0) AS above_streak, pos - coalesce(lnb, -1) AS below_streak FROM a),
c AS (SELECT *, max(CASE WHEN score < 1 AND below_streak >= 2 THEN pos END) OVER {_EW} AS rel,
  CASE WHEN score < 2 THEN 0 WHEN above_streak >= 3 AND conf >= 2 THEN 3 WHEN above_streak >= 2 THEN 2 ELSE 1 END AS lvl FROM b)
SELECT event_type, ts, CAST(above_streak AS BIGINT) AS above_streak, below_streak,
  list_extract(['NORMAL', 'OBSERVE', 'WARNING', 'BREAK_CONFIRMED'], max(lvl) OVER (PARTITION BY event_type, coalesce(rel, -1) ORDER BY ts) + 1) AS state FROM c""",
)
def event_states(spark, sf):
    z = dt.baseline_standardize(_event_series(spark, sf), keys=["event_type"], order=_EVENT_ORDER, value="value", block="piece")
    scored = z.withColumns({"score": F.abs("z"), "confirmations": F.when(F.col("value") > 50, 2).otherwise(1)})
    clean = dt.split_state_input(scored).clean
    out = dt.hysteresis(clean, keys=["event_type"], order=_EVENT_ORDER, block="piece")
    return out.select("event_type", "ts", "above_streak", "below_streak", "state")


# the state machine unrolled in SQL: one recursive step per row would be slow, so the oracle
# lists streaks by counting rows since the last resetting row
def _hysteresis_sql(source: str, name: str = "states") -> str:
    return f"""{name}_in AS (SELECT oktmo, category_code, period_start, pos, abs(z) AS score, CAST(cusum_flag AS INTEGER) * 2 AS confirmations FROM {source}),
{name}0 AS (SELECT *, max(CASE WHEN score < 1 THEN pos END) OVER {_W} AS last_below,
  max(CASE WHEN score >= 1 THEN pos END) OVER {_W} AS last_not_below FROM {name}_in),
{name}1 AS (SELECT *, (SELECT count(*) FROM {name}_in b WHERE b.oktmo = a.oktmo AND b.category_code = a.category_code
      AND b.score >= 2 AND b.pos <= a.pos AND b.pos > coalesce(a.last_below, -1)) AS above_streak,
  pos - coalesce(last_not_below, -1) AS below_streak FROM {name}0 a),
{name}2 AS (SELECT *, max(CASE WHEN score < 1 AND below_streak >= 2 THEN pos END) OVER {_W} AS last_release,
  CASE WHEN score < 2 THEN 0 WHEN above_streak >= 3 AND confirmations >= 2 THEN 3 WHEN above_streak >= 2 THEN 2 ELSE 1 END AS lvl FROM {name}1),
{name}3 AS (SELECT *, max(lvl) OVER (PARTITION BY oktmo, category_code, coalesce(last_release, -1) ORDER BY pos) AS st FROM {name}2),
{name} AS (SELECT *, list_extract(['NORMAL', 'OBSERVE', 'WARNING', 'BREAK_CONFIRMED'], st + 1) AS state,
  CASE WHEN score >= 2 AND above_streak >= 3 AND confirmations >= 2 THEN 'CONFIRMED' WHEN score >= 2 AND st = 2 THEN 'SUSTAINED'
       WHEN score >= 2 THEN 'CANDIDATE' WHEN score < 1 AND below_streak >= 2 THEN 'RELEASED' WHEN score < 1 THEN 'RELEASE_PENDING'
       WHEN st = 0 THEN 'BAND_NORMAL' WHEN st = 1 THEN 'BAND_OBSERVE' ELSE 'BAND_ACTIVE' END AS reason_code FROM {name}3)"""


def _scored(df):
    return df.withColumns({"score": F.abs("z"), "confirmations": F.col("cusum_flag").cast("int") * 2})


def _states(df):
    clean = dt.split_state_input(_scored(df)).clean
    return dt.hysteresis(clean, keys=KEYS, order="period_start")


@query(
    "hysteresis_states",
    f"""WITH {data.panel_sql('nation')}, {_z_sql('nation')}, {_cusum_sql(5.0)}, {_hysteresis_sql('cusum')}
SELECT oktmo, category_code, period_start, confirmations, above_streak, below_streak, state, reason_code FROM states""",
)
def hysteresis_states(spark, sf):
    df = _states(_cusum(spark, sf, "nation"))
    return df.select(*KEYS, "period_start", "confirmations", "above_streak", "below_streak", "state", "reason_code")


@query(
    "dual_state",
    f"""WITH {data.panel_sql('nation')}, {_z_sql('nation')}, {_cusum_sql(5.0)}, {_hysteresis_sql('cusum')},
{data.QUANTITY_PANEL_SQL}, {_z_sql('nation', source='qpanel', name='zq')}, {_cusum_sql(5.0, source='zq', name='cusumq')}, {_hysteresis_sql('cusumq', 'qstates')},
a AS (SELECT oktmo, period_start, max(st) AS st, max(score) AS score FROM states GROUP BY 1, 2),
b AS (SELECT oktmo, period_start, max(st) AS st, max(score) AS score FROM qstates GROUP BY 1, 2),
j AS (SELECT oktmo, period_start, 2 * CAST(a.st >= 2 AS INTEGER) + CAST(b.st >= 2 AS INTEGER) AS code,
  a.score / (1 + a.score) AS x, b.score / (1 + b.score) AS y FROM a JOIN b USING (oktmo, period_start))
SELECT oktmo, period_start, code AS dual_code,
  list_extract(['NORMAL', 'EARLY_WARNING', 'FISCAL_DIVERGENCE', 'SYSTEMIC_STRESS'], code + 1) AS dual_state,
  {r("1 - (1 - x) * (1 - y)", 8)} AS fusion_score FROM j""",
)
def dual_state(spark, sf):
    position = F.create_map(*[F.lit(x) for i, s in enumerate(dt.STATES) for x in (s, i)])

    def contour(panel, name):
        states = _states(dt.cusum(panel, keys=KEYS, **ORDER))
        top = F.max_by("state", F.element_at(position, F.col("state")))
        return states.groupBy("oktmo", "period_start").agg(top.alias(f"{name}_state"), F.max("score").alias(f"{name}_score"))

    reference = contour(data.panel(spark, sf, "nation"), "reference")
    predictive = contour(data.quantity_panel(spark, sf), "predictive")
    joined = reference.join(predictive, ["oktmo", "period_start"])
    unit = lambda c: F.col(c) / (1.0 + F.col(c))
    return joined.select(
        "oktmo",
        "period_start",
        S.dual_state_code("reference_state", "predictive_state").alias("dual_code"),
        S.dual_state("reference_state", "predictive_state").alias("dual_state"),
        F.round(S.noisy_or(unit("reference_score"), unit("predictive_score")), 8).alias("fusion_score"),
    )


def _threshold_sql(detector: str, peaks: str, candidates) -> str:
    listed = ", ".join(f"({c}::DOUBLE)" for c in candidates)
    return f"""SELECT '{detector}' AS detector, arg_min(h, CASE WHEN rate <= 0.4 THEN h ELSE 1e9 - h END) AS parameter,
  {r("arg_min(rate, CASE WHEN rate <= 0.4 THEN h ELSE 1e9 - h END)", 9)} AS null_path_fpr, bool_or(rate <= 0.4) AS target_met
FROM (SELECT h, avg(CASE WHEN peak > h THEN 1.0 ELSE 0.0 END) AS rate FROM {peaks}, (VALUES {listed}) c(h) GROUP BY h)"""


@query(
    "threshold_choice",
    f"""WITH RECURSIVE {data.panel_sql('nation')}, {_z_sql('nation')}, {_cusum_sql(5.0)}, {_ph_sql(8.0)}, {_pelt_sql(dt.PELT_CANDIDATES)},
cp AS (SELECT oktmo, category_code, max(greatest(abs(cusum_up), abs(cusum_down))) AS peak FROM cusum GROUP BY 1, 2),
pp AS (SELECT oktmo, category_code, max(greatest(ph_up, ph_down)) AS peak FROM ph GROUP BY 1, 2),
pc AS (SELECT penalty, count(DISTINCT (oktmo, category_code)) AS flagged FROM pelt GROUP BY 1),
pr AS (SELECT h, coalesce(flagged, 0) / (SELECT count(DISTINCT (oktmo, category_code)) FROM panel)::DOUBLE AS rate
  FROM (VALUES {", ".join(f"({c}::DOUBLE)" for c in dt.PELT_CANDIDATES)}) c(h) LEFT JOIN pc ON penalty = h)
{_threshold_sql('CUSUM', 'cp', dt.CUSUM_CANDIDATES)}
UNION ALL {_threshold_sql('PAGE_HINKLEY', 'pp', dt.PAGE_HINKLEY_CANDIDATES)}
UNION ALL SELECT 'PELT', arg_min(h, CASE WHEN rate <= 0.4 THEN h ELSE 1e9 - h END), {r("arg_min(rate, CASE WHEN rate <= 0.4 THEN h ELSE 1e9 - h END)", 9)}, bool_or(rate <= 0.4) FROM pr""",
)
def threshold_choice(spark, sf):
    a = dt.peak_statistic(_cusum(spark, sf, "nation"), keys=KEYS, sides=["cusum_up", "cusum_down"])
    b = dt.peak_statistic(_page_hinkley(spark, sf, "nation"), keys=KEYS, sides=["ph_up", "ph_down"])
    a = dt.choose_threshold(a, candidates=dt.CUSUM_CANDIDATES, target_rate=0.4).withColumn("detector", F.lit("CUSUM"))
    b = dt.choose_threshold(b, candidates=dt.PAGE_HINKLEY_CANDIDATES, target_rate=0.4).withColumn("detector", F.lit("PAGE_HINKLEY"))
    breaks = _pelt(spark, sf, dt.PELT_CANDIDATES)
    c = dt.choose_penalty(data.panel(spark, sf, "nation"), breaks, keys=KEYS, candidates=dt.PELT_CANDIDATES, target_rate=0.4)
    return rounded(a.unionByName(b).unionByName(c.withColumn("detector", F.lit("PELT"))), 9, "null_path_fpr")


# ---- events ------------------------------------------------------------------

_EVENTS_SQL = f"""moves AS (SELECT oktmo, category_code, pos, abs(z - lag(z) OVER {_W}) AS move FROM z),
labelled AS (SELECT oktmo, category_code, CAST(arg_max(pos, move) AS INTEGER) AS start,
  2 * CAST(substr(category_code, 1, 1) AS INTEGER) - 1 AS duration FROM moves WHERE pos >= 13 GROUP BY 1, 2)"""


def _events(z):
    """One labelled event per series: its largest step after the warm-up, long for low priorities."""
    from pyspark.sql import Window

    by = Window.partitionBy(*KEYS).orderBy("period_start")
    moves = z.select(*KEYS, "pos", F.abs(F.col("z") - F.lag("z", 1).over(by)).alias("move"))
    return (
        moves.where(F.col("pos") >= 13)
        .groupBy(*KEYS)
        .agg(F.max_by("pos", "move").alias("start"))
        .withColumn("duration", 2 * F.substring("category_code", 1, 1).cast("int") - 1)
    )


def _alarms(spark, sf):
    """First alarm of every series for both online detectors."""
    out = None
    for name, flagged, flag in (
        ("CUSUM", _cusum(spark, sf, "nation"), "cusum_flag"),
        ("PAGE_HINKLEY", _page_hinkley(spark, sf, "nation"), "page_hinkley_flag"),
    ):
        rows = dt.first_alarm(flagged, keys=KEYS, flag=flag).withColumn("detector", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def _matched(spark, sf):
    """Events against the alarms of both online detectors and the breaks of the offline one."""
    z = dt.baseline_standardize(data.panel(spark, sf, "nation"), keys=KEYS, **ORDER)
    online = dt.match_alarms(_alarms(spark, sf), _events(z), keys=KEYS)
    offline = dt.match_breaks(_pelt(spark, sf), _events(z), keys=KEYS).withColumn("detector", F.lit("PELT"))
    return online.unionByName(offline, allowMissingColumns=True)


_MATCHED_SQL = f"""{data.panel_sql('nation')}, {_z_sql('nation')}, {_cusum_sql(5.0)}, {_ph_sql(8.0)}, {_EVENTS_SQL}, {_pelt_sql((1.0,))},
alarms AS (SELECT 'CUSUM' AS detector, oktmo, category_code, CAST(min(pos) FILTER (cusum_flag) AS INTEGER) AS first_alarm FROM cusum GROUP BY ALL
  UNION ALL SELECT 'PAGE_HINKLEY', oktmo, category_code, CAST(min(pos) FILTER (page_hinkley_flag) AS INTEGER) FROM ph GROUP BY ALL),
nearest AS (SELECT oktmo, category_code, start, duration, CAST(min(abs(break_pos - start)) AS INTEGER) AS localization_error
  FROM labelled LEFT JOIN pelt USING (oktmo, category_code) GROUP BY ALL),
matched AS (SELECT detector, oktmo, category_code, start, duration, first_alarm,
  coalesce(first_alarm BETWEEN start AND start + duration + 2, false) AS detected, coalesce(first_alarm < start, false) AS false_early,
  CASE WHEN first_alarm BETWEEN start AND start + duration + 2 THEN first_alarm - start END AS delay,
  CASE WHEN duration <= 3 THEN 'TRANSIENT_SHOCK' ELSE 'REGIME_SHIFT' END AS event_type, CAST(NULL AS INTEGER) AS localization_error
  FROM labelled JOIN alarms USING (oktmo, category_code)
  UNION ALL SELECT 'PELT', oktmo, category_code, start, duration, NULL, coalesce(localization_error <= 2, false), NULL, NULL,
  CASE WHEN duration <= 3 THEN 'TRANSIENT_SHOCK' ELSE 'REGIME_SHIFT' END, localization_error FROM nearest),
summary AS (SELECT detector, event_type, avg(CAST(detected AS DOUBLE)) AS detection_rate,
  avg(CAST(false_early AS DOUBLE)) AS false_early_rate, median(delay) AS median_delay, median(localization_error) AS median_localization_error, count(*) AS events
  FROM matched GROUP BY 1, 2)"""


@query("event_detection", f"WITH RECURSIVE {_MATCHED_SQL} SELECT * FROM matched")
def event_detection(spark, sf):
    return _matched(spark, sf)


@query(
    "detection_summary",
    f"""WITH RECURSIVE {_MATCHED_SQL} SELECT detector, event_type, {r("detection_rate", 9)} AS detection_rate,
  {r("false_early_rate", 9)} AS false_early_rate, median_delay, median_localization_error, events FROM summary""",
)
def detection_summary(spark, sf):
    return rounded(dt.detection_summary(_matched(spark, sf)), 9, "detection_rate", "false_early_rate")


@query(
    "best_online_detector",
    f"""WITH RECURSIVE {_MATCHED_SQL} SELECT arg_min(detector, (-detection_rate, detector)) AS detector, {r("max(detection_rate)", 9)} AS detection_rate
FROM summary WHERE event_type = 'REGIME_SHIFT' AND detector <> 'PELT'""",
)
def best_online_detector(spark, sf):
    return rounded(dt.best_online_detector(dt.detection_summary(_matched(spark, sf))), 9, "detection_rate")


@query(
    "calibrated_summary",
    f"""WITH RECURSIVE {_MATCHED_SQL}, cal AS (SELECT detector, avg(CASE WHEN first_alarm IS NOT NULL THEN 1.0 ELSE 0.0 END) AS null_path_fpr
  FROM alarms GROUP BY 1 UNION ALL SELECT 'PELT', (SELECT count(DISTINCT (oktmo, category_code)) FROM pelt) / (SELECT count(DISTINCT (oktmo, category_code)) FROM panel)::DOUBLE)
SELECT detector, event_type, {r("detection_rate", 9)} AS detection_rate, {r("null_path_fpr", 9)} AS null_path_fpr
FROM summary LEFT JOIN cal USING (detector)""",
)
def calibrated_summary(spark, sf):
    alarms = _alarms(spark, sf)
    cal = alarms.groupBy("detector").agg(F.avg(F.col("first_alarm").isNotNull().cast("double")).alias("null_path_fpr"))
    flagged = data.panel(spark, sf, "nation").select(*KEYS).distinct().join(_pelt(spark, sf).select(*KEYS, F.lit(1).alias("hit")).distinct(), KEYS, "left")
    offline = flagged.agg(F.lit("PELT").alias("detector"), F.avg(F.col("hit").isNotNull().cast("double")).alias("null_path_fpr"))
    joined = dt.with_calibration(dt.detection_summary(_matched(spark, sf)), cal.unionByName(offline))
    return rounded(joined.select("detector", "event_type", "detection_rate", "null_path_fpr"), 9, "detection_rate", "null_path_fpr")


@query(
    "scenario_summary",
    f"""WITH RECURSIVE {_MATCHED_SQL}, scen AS (
  SELECT detector, event_type, oktmo, avg(CAST(detected AS DOUBLE)) AS detection_rate, avg(CAST(false_early AS DOUBLE)) AS false_early_rate,
    median(delay) AS median_delay_periods, median(localization_error) AS median_localization_error FROM matched GROUP BY 1, 2, 3)
SELECT detector, event_type, {r("avg(detection_rate)", 9)} AS mean_detection_rate, {r("avg(false_early_rate)", 9)} AS mean_false_early_rate,
  median(median_delay_periods) AS median_delay, median(median_localization_error) AS median_localization_error
FROM scen GROUP BY 1, 2""",
)
def scenario_summary(spark, sf):
    rows = _matched(spark, sf).groupBy("detector", "event_type", "oktmo").agg(
        F.avg(F.col("detected").cast("double")).alias("detection_rate"),
        F.avg(F.col("false_early").cast("double")).alias("false_early_rate"),
        F.median("delay").alias("median_delay_periods"),
        F.median("localization_error").alias("median_localization_error"),
    )
    return rounded(dt.scenario_summary(rows), 9, "mean_detection_rate", "mean_false_early_rate")


@query(
    "detector_confirmations",
    f"""WITH RECURSIVE {data.panel_sql('nation')}, {_z_sql('nation')}, {_cusum_sql(5.0)}, {_pelt_sql((1.0,))},
near AS (SELECT DISTINCT oktmo, category_code, break_pos + d AS pos FROM pelt, (VALUES (-1), (0), (1)) v(d))
SELECT oktmo, category_code, period_start, cusum_flag, near.pos IS NOT NULL AS break_near,
  CAST(cusum_flag AS INTEGER) + CAST(near.pos IS NOT NULL AS INTEGER) AS confirmations
FROM cusum LEFT JOIN near USING (oktmo, category_code, pos)""",
)
def detector_confirmations(spark, sf):
    """An online alarm next to a break of the offline search counts twice."""
    out = dt.confirmations(_cusum(spark, sf, "nation"), _pelt(spark, sf), keys=KEYS)
    return out.select(*KEYS, "period_start", "cusum_flag", "break_near", "confirmations")


@query(
    "break_matches",
    f"""WITH RECURSIVE {data.panel_sql('nation')}, {_z_sql('nation')}, {_EVENTS_SQL}, {_pelt_sql((1.0,))},
near AS (SELECT oktmo, category_code, start, duration, CAST(min(abs(break_pos - start)) AS INTEGER) AS localization_error
  FROM labelled LEFT JOIN pelt USING (oktmo, category_code) GROUP BY ALL)
SELECT *, coalesce(localization_error <= 2, false) AS detected,
  CASE WHEN duration <= 3 THEN 'TRANSIENT_SHOCK' ELSE 'REGIME_SHIFT' END AS event_type FROM near""",
)
def break_matches(spark, sf):
    z = dt.baseline_standardize(data.panel(spark, sf, "nation"), keys=KEYS, **ORDER)
    return dt.match_breaks(_pelt(spark, sf), _events(z), keys=KEYS)


@query("pelt_breaks", f"WITH RECURSIVE {data.panel_sql('nation')}, {_pelt_sql((1.0, 3.0))} SELECT oktmo, category_code, penalty, break_pos FROM pelt")
def pelt_breaks_query(spark, sf):
    return _pelt(spark, sf, (1.0, 3.0))


@query(
    "probability_state",
    f"""WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2),
p AS (SELECT user_id, event_type, c / sum(c) OVER (PARTITION BY user_id) AS p FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS k, lead(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS nxt FROM p)
SELECT user_id, CASE WHEN nxt IS NOT NULL AND p - nxt < 0.02 THEN 'UNCERTAIN' ELSE event_type END AS state, {r("p - nxt", 9)} AS margin
FROM o WHERE k = 1""",
)
def probability_state(spark, sf):
    counts = data.read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("user_id").agg(F.sum("c").alias("total"))
    shares = counts.join(totals, "user_id").withColumn("p", F.col("c") / F.col("total"))
    out = dt.probability_state(shares, keys=["user_id"], label="event_type", probability="p", min_margin=0.02)
    return rounded(out, 9, "margin")


# ---- scores ------------------------------------------------------------------


def _judged(spark, sf):
    docs = data.read(spark, sf, "documents").select("doc_id", "source", "n_chars", F.size(F.split("text", " ")).alias("words"))
    return docs.join(data.read(spark, sf, "labels"), "doc_id")


_JUDGED_SQL = "judged AS (SELECT doc_id, source, n_chars, len(string_split(text, ' ')) AS words, quality, toxic FROM documents JOIN labels USING (doc_id))"


def _auc_sql(score: str) -> str:
    return (
        f"SELECT (sum(CASE WHEN quality = 1 THEN rk END) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))::DOUBLE) "
        f"FROM (SELECT quality, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk FROM judged)"
    )


def _ap_sql(score: str) -> str:
    return (
        f"SELECT sum(CASE WHEN quality = 1 THEN tp / k END) / sum(quality) FROM (SELECT quality, "
        f"sum(quality) OVER (ORDER BY {score} DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (ORDER BY {score} DESC, doc_id) AS k FROM judged)"
    )


@query(
    "roc_auc",
    f"""WITH {_JUDGED_SQL}, t AS (SELECT toxic, n_chars, quality, rank() OVER (PARTITION BY toxic ORDER BY n_chars)
  + (count(*) OVER (PARTITION BY toxic, n_chars) - 1) / 2.0 AS rk FROM judged)
SELECT toxic, {r("(sum(rk) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * (count(*) - sum(quality)), 0)::DOUBLE", 9)} AS roc_auc,
  CAST(sum(quality) AS BIGINT) AS positives, CAST(count(*) - sum(quality) AS BIGINT) AS negatives FROM t GROUP BY 1""",
)
def roc_auc(spark, sf):
    return rounded(mt.roc_auc(_judged(spark, sf), keys=["toxic"], truth="quality", score="n_chars"), 9, "roc_auc")


@query(
    "average_precision",
    f"""WITH {_JUDGED_SQL}, t AS (SELECT toxic, quality, sum(quality) OVER (PARTITION BY toxic ORDER BY words DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp,
  row_number() OVER (PARTITION BY toxic ORDER BY words DESC, doc_id) AS k FROM judged)
SELECT toxic, {r("sum(tp / k) FILTER (quality = 1) / sum(quality)", 9)} AS average_precision, CAST(sum(quality) AS BIGINT) AS positives
FROM t GROUP BY 1 HAVING sum(quality) > 0""",
)
def average_precision(spark, sf):
    out = mt.average_precision(_judged(spark, sf), keys=["toxic"], truth="quality", score="words", seq="doc_id")
    return rounded(out, 9, "average_precision")


_DUAL = ("n_chars", "words", "n_chars + 5 * words")
_DUAL_SQL = ", ".join(
    f"{r(f'({fn(score)})', 9)} AS {short}_{name}"
    for short, fn in (("roc_auc", _auc_sql), ("pr_auc", _ap_sql))
    for name, score in zip(("reference", "predictive", "dual"), _DUAL)
)


@query(
    "dual_value",
    f"""WITH {_JUDGED_SQL}, v AS (SELECT {_DUAL_SQL.replace("round(", "(").replace(", 9) + 0.0)", "))")})
SELECT {", ".join(r(f"{s}_{n}", 9) + f" AS {s}_{n}" for s in ("roc_auc", "pr_auc") for n in ("reference", "predictive", "dual"))},
  {r("roc_auc_dual - greatest(roc_auc_reference, roc_auc_predictive)", 9)} AS delta_roc_auc,
  {r("pr_auc_dual - greatest(pr_auc_reference, pr_auc_predictive)", 9)} AS delta_pr_auc FROM v""",
)
def dual_value(spark, sf):
    judged = _judged(spark, sf).withColumn("both", F.col("n_chars") + 5 * F.col("words"))
    out = mt.dual_value(judged, truth="quality", reference="n_chars", predictive="words", dual="both", seq="doc_id")
    return rounded(out, 9, *out.columns)


_AREA_SCORES = ("n_chars", "words", "n_chars + 5 * words")
_AREA_SQL = f"""{_JUDGED_SQL},
scored AS (SELECT toxic, doc_id, quality AS y, n_chars AS s0, words AS s1, n_chars + 5 * words AS s2 FROM judged),
placed AS (SELECT a.toxic, a.doc_id, a.y, {", ".join(f"avg(CASE WHEN a.s{i} = b.s{i} THEN 0.5 WHEN (a.s{i} > b.s{i}) = (a.y = 1) THEN 1.0 ELSE 0 END) AS v{i}" for i in range(3))}
  FROM scored a JOIN scored b ON a.toxic = b.toxic AND a.y <> b.y GROUP BY ALL),
moments AS (SELECT toxic, y, count(*) AS n, {", ".join(f"avg(v{i}) AS m{i}" for i in range(3))}, {", ".join(f"var_samp(v2 - v{i}) / count(*) AS d{i}" for i in range(2))} FROM placed GROUP BY 1, 2),
sides AS (SELECT toxic, p.n AS positives, q.n AS negatives, p.m2 AS auc, [p.m0, p.m1] AS others, [p.d0 + q.d0, p.d1 + q.d1] AS variances
  FROM (SELECT * FROM moments WHERE y = 1) p JOIN (SELECT * FROM moments WHERE y = 0) q USING (toxic)),
areas AS (SELECT toxic, positives, negatives, auc, ['n_chars', 'words'][i] AS against, others[i] AS auc_against, variances[i] AS variance FROM sides, (VALUES (1), (2)) v(i)),
tests AS (SELECT *, auc - auc_against AS difference, CASE WHEN variance > 1e-15 THEN (auc - auc_against) / sqrt(variance) END AS statistic FROM areas),
tails AS (SELECT toxic, against, 1 - sum(h * (exp(-0.5 * (2 * i * h) ** 2) + 4 * exp(-0.5 * ((2 * i + 1) * h) ** 2) + exp(-0.5 * ((2 * i + 2) * h) ** 2)) / 3) * 2 / sqrt(2 * pi()) AS p_value
  FROM (SELECT toxic, against, least(abs(statistic), 9) / 2000 AS h FROM tests), generate_series(0, 999) g(i) GROUP BY 1, 2)"""


@query(
    "area_tests",
    f"""WITH {_AREA_SQL}
SELECT toxic, against, {r("auc", 9)} AS auc, {r("auc_against", 9)} AS auc_against, {r("difference", 9)} AS difference, {r("variance", 10)} AS variance,
  {r("statistic", 6)} AS statistic, {r("greatest(p_value, 0)", 7)} AS p_value, positives, negatives, positives >= 20 AND negatives >= 20 AS usable
FROM tests JOIN tails USING (toxic, against)""",
)
def area_tests(spark, sf):
    """Is the area of the fused score larger than that of either single one?"""
    judged = _judged(spark, sf).withColumn("both", F.col("n_chars") + 5 * F.col("words"))
    out = sg.delong(judged, keys=["toxic"], truth="quality", scores=["n_chars", "words", "both"]).where("auc IS NOT NULL").drop("score")
    return rounded(rounded(rounded(rounded(out, 9, "auc", "auc_against", "difference"), 10, "variance"), 6, "statistic"), 7, "p_value")


_FALLS_SQL = f"""{data.panel_sql('nation')}, {_z_sql('nation')}, {_cusum_sql(5.0)},
judged AS (SELECT oktmo, category_code, year(period_start) AS y, round(greatest(abs(cusum_up), abs(cusum_down)), 6) AS score,
    CASE WHEN lead(spending_nominal) OVER {_W} < 0.8 * spending_nominal THEN 1 ELSE 0 END AS truth FROM cusum),
effects AS (SELECT category_code, t.h AS threshold, count(*) FILTER (truth = 1 AND score >= t.h) AS found, count(*) FILTER (truth = 0 AND score >= t.h) AS false_alarms,
    count(*) FILTER (truth = 1 AND score < t.h) AS missed FROM (SELECT * FROM judged WHERE y < 2000) JOIN (SELECT DISTINCT category_code, score AS h FROM judged WHERE y < 2000) t USING (category_code) GROUP BY 1, 2),
utility AS (SELECT *, 3.0::DOUBLE * found - false_alarms - 2 * missed - 5 AS net_effect FROM effects),
frozen AS (SELECT * FROM utility QUALIFY row_number() OVER (PARTITION BY category_code ORDER BY net_effect DESC, threshold DESC) = 1)"""


def _falls(spark, sf):
    """Every month with the size of the online statistic, and whether spending falls by a fifth in the next one."""
    from pyspark.sql import Window

    df = _cusum(spark, sf, "nation")
    following = F.lead("spending_nominal").over(Window.partitionBy(*KEYS).orderBy("period_start"))
    size = F.greatest(F.abs("cusum_up"), F.abs("cusum_down"))
    falls = F.coalesce(following < 0.8 * F.col("spending_nominal"), F.lit(False)).cast("int")
    return df.select(*KEYS, F.year("period_start").alias("y"), F.round(size, 6).alias("score"), falls.alias("truth"))


_COSTS = {"benefit": 3.0, "false_alarm": 1.0, "miss": 2.0, "model_cost": 5.0}


@query(
    "utility_thresholds",
    f"""WITH {_FALLS_SQL} SELECT category_code, threshold, found, false_alarms, missed, net_effect FROM frozen""",
)
def utility_thresholds(spark, sf):
    development = _falls(spark, sf).where("y < 2000")
    return sg.best_threshold(sg.utility_by_threshold(development, keys=["category_code"], truth="truth", score="score", **_COSTS), keys=["category_code"])


@query(
    "net_effect_interval",
    f"""WITH {_FALLS_SQL},
pays AS (SELECT category_code, oktmo, y, sum(CASE WHEN score >= threshold AND truth = 1 THEN 3.0 WHEN score >= threshold THEN -1 WHEN truth = 1 THEN -2 ELSE 0 END) AS e
  FROM (SELECT * FROM judged WHERE y >= 2000) JOIN frozen USING (category_code) GROUP BY ALL),
units AS (SELECT category_code, oktmo, y, e - 5.0 / count(*) OVER (PARTITION BY category_code) AS a, 1.0 AS b FROM pays),
{_resampled_sql("units", ("category_code", "oktmo", "y"), "category_code")}
SELECT category_code, units, {r("estimate", 8)} AS estimate, {r("lower", 8)} AS lower, {r("upper", 8)} AS upper, {r("share_above", 6)} AS share_above, lower > 0 AS accepted
FROM sizes JOIN ends USING (category_code)""",
)
def net_effect_interval(spark, sf):
    """Thresholds frozen on the development years, effect a territory and year after them."""
    rows = _falls(spark, sf)
    frozen = sg.best_threshold(sg.utility_by_threshold(rows.where("y < 2000"), keys=["category_code"], truth="truth", score="score", **_COSTS), keys=["category_code"])
    out = sg.net_effect_interval(rows.where("y >= 2000"), frozen, keys=["category_code"], unit=["oktmo", "y"], truth="truth", score="score", **_COSTS)
    return rounded(rounded(out, 8, "estimate", "lower", "upper"), 6, "share_above")


@query(
    "lead_time_interval",
    f"""WITH {data.panel_sql('nation')}, {_z_sql('nation')}, {_cusum_sql(5.0)}, {_ph_sql(8.0)},
a AS (SELECT oktmo, category_code, min(period_start) FILTER (cusum_flag) AS signal FROM cusum GROUP BY 1, 2),
b AS (SELECT oktmo, category_code, min(period_start) FILTER (page_hinkley_flag) AS confirmed FROM ph GROUP BY 1, 2),
units AS (SELECT category_code, oktmo, date_diff('day', signal, confirmed) AS a, 1.0 AS b FROM a JOIN b USING (oktmo, category_code) WHERE signal IS NOT NULL AND confirmed IS NOT NULL),
drawn AS (SELECT *, {rs.hashed_sql("1", "k", "category_code", "oktmo")} AS x FROM units, generate_series(1, 2000) g(k)),
replicates AS (SELECT category_code, k, quantile_disc(a, 0.5) AS v FROM (SELECT category_code, k, a, unnest(range({rs.weight_sql("x")})) FROM drawn) GROUP BY 1, 2),
ends AS (SELECT category_code, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS share_above FROM replicates GROUP BY 1),
sizes AS (SELECT category_code, count(*) AS units, CAST(quantile_disc(a, 0.5) AS DOUBLE) AS estimate FROM units GROUP BY 1)
SELECT category_code, units, estimate, CASE WHEN units >= 10 THEN lower + 0.0 END AS lower, CASE WHEN units >= 10 THEN upper + 0.0 END AS upper,
  {r("CASE WHEN units >= 10 THEN share_above END", 6)} AS share_above
FROM sizes JOIN ends USING (category_code)""",
)
def lead_time_interval(spark, sf):
    """Median lead of the signal over its confirmation, territories resampled."""
    return rounded(rs.quantile_interval(lead_time(spark, sf), keys=["category_code"], unit=["oktmo"], value="lead_days"), 6, "share_above")


@query(
    "precision_recall",
    f"""WITH {_JUDGED_SQL}, g AS (SELECT source, count(*) FILTER (quality = 1 AND n_chars >= 1000) AS tp,
  count(*) FILTER (quality = 0 AND n_chars >= 1000) AS fp, count(*) FILTER (quality = 1 AND n_chars < 1000) AS fn FROM judged GROUP BY 1)
SELECT source, {r("coalesce(tp / nullif(tp + fp, 0), 0)", 9)} AS precision, {r("coalesce(tp / nullif(tp + fn, 0), 0)", 9)} AS recall FROM g""",
)
def precision_recall(spark, sf):
    df = _judged(spark, sf).withColumn("alarm", (F.col("n_chars") >= 1000).cast("int"))
    return rounded(mt.precision_recall(df, keys=["source"], truth="quality", alarm="alarm"), 9, "precision", "recall")


@query(
    "false_alarm_rate",
    f"""WITH {data.panel_sql('nation')}, {_z_sql('nation')}, {_cusum_sql(5.0)},
t AS (SELECT oktmo, year(period_start) AS y, cusum_flag AND z < 1 AS fp FROM cusum)
SELECT CAST(count(*) FILTER (fp) AS BIGINT) AS false_alarms, count(DISTINCT (oktmo, y)) AS units,
  {r("count(*) FILTER (fp) / count(DISTINCT (oktmo, y))", 9)} AS false_alarms_per_entity_year FROM t""",
)
def false_alarm_rate(spark, sf):
    df = _cusum(spark, sf, "nation").select(
        "oktmo",
        F.year("period_start").alias("year"),
        F.col("cusum_flag").cast("int").alias("alarm"),
        (F.col("z") >= 1).cast("int").alias("truth"),
    )
    out = mt.false_alarms_per_unit(df, entity="oktmo", year="year", alarm="alarm", truth="truth")
    return rounded(out, 9, "false_alarms_per_entity_year")


@query(
    "lead_time",
    f"""WITH {data.panel_sql('nation')}, {_z_sql('nation')}, {_cusum_sql(5.0)}, {_ph_sql(8.0)},
a AS (SELECT oktmo, category_code, min(period_start) FILTER (cusum_flag) AS signal FROM cusum GROUP BY 1, 2),
b AS (SELECT oktmo, category_code, min(period_start) FILTER (page_hinkley_flag) AS confirmed FROM ph GROUP BY 1, 2)
SELECT oktmo, category_code, CAST(date_diff('day', signal, confirmed) AS INTEGER) AS lead_days FROM a JOIN b USING (oktmo, category_code)""",
)
def lead_time(spark, sf):
    a = dt.first_alarm(_cusum(spark, sf, "nation"), keys=KEYS, flag="cusum_flag", at="period_start")
    b = dt.first_alarm(_page_hinkley(spark, sf, "nation"), keys=KEYS, flag="page_hinkley_flag", at="period_start")
    joined = a.join(b.withColumnRenamed("first_alarm", "confirmed"), KEYS)
    return joined.select(*KEYS, mt.lead_time_days("first_alarm", "confirmed").alias("lead_days"))


@query(
    "mid_ranks",
    f"""SELECT DISTINCT c_mktsegment, c_nationkey, count(*) OVER v AS ties, count(*) OVER (PARTITION BY c_mktsegment) AS group_size,
  {r("rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER v - 1) / 2.0", 1)} AS mid_rank,
  {r("cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey)", 9)} AS percentile_rank
FROM customer WINDOW v AS (PARTITION BY c_mktsegment, c_nationkey)""",
)
def mid_ranks(spark, sf):
    out = px.value_ranks(data.read(spark, sf, "customer"), ["c_mktsegment"], "c_nationkey")
    return out.withColumns({"mid_rank": F.round("mid_rank", 1), "percentile_rank": F.round("percentile_rank", 9)})
