"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the driver's tables (through the shots/sessions views) and
computes over ALL users at once (``by=("user_id",)``); nothing is filtered
to a subset to make it cheap.  Double outputs are rounded to 6 decimals on
both sides for comparison (sums of doubles depend on evaluation order).
"""

from __future__ import annotations

import datetime as dt
import math
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.functions.expr import NUMBER_RX, round_doubles
from shotspark.operators import deliverables as dv
from shotspark.operators import clean as cl
from shotspark.operators import dispersion as ds
from shotspark.operators import gapping as gp
from shotspark.operators import ordering as od
from shotspark.operators import reshape as rs
from shotspark.operators import shapes as sh
from shotspark.operators import wind as wd
from shotspark.plans.ingest import ingest_frame, upload_sessions
from shotspark.plans.oracle import SESSIONS_CTE, dbl, r6, rnd, with_shots
from shotspark.schema import (BASE_CARRY, CLUBS, ELLIPSE_POINTS, GAP_EDGES, METRIC_TITLES, METRICS,
                              PERFORMANCE_METRICS, SCRIPT_HEADWIND_PENALTY, SCRIPT_MEAN_COLUMNS,
                              SCRIPT_TAILWIND_SUBTRACT, SCRIPT_WIND_MULTIPLIERS, WIND_FACTORS)
from shotspark.session import counted
from shotspark.sources import csv_sessions as csvs
from shotspark.sources import tables as tb
from shotspark.sources import testdata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BY = ("user_id",)


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: round_doubles(fn(spark, sf_dir))
        QUERIES[name].__name__ = name
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# --------------------------------------------------------------------------
# A3 carry averages
# --------------------------------------------------------------------------
_CARRY_BODY = f"""
SELECT user_id, club_type, count(*) AS shots,
  {r6('avg(carry_distance)')} AS avg_carry_yd,
  {r6('stddev_samp(carry_distance)')} AS std_carry_yd,
  {r6('quantile_cont(carry_distance, 0.1)')} AS p10_carry_yd,
  {r6('quantile_cont(carry_distance, 0.5)')} AS p50_carry_yd,
  {r6('quantile_cont(carry_distance, 0.9)')} AS p90_carry_yd
FROM shots GROUP BY user_id, club_type"""
_CARRY_ORACLE = with_shots(_CARRY_BODY)


@register("carry_averages", _CARRY_ORACLE)
def q_carry_averages(spark, sf_dir):
    return dv.carry_averages(testdata.shots(spark, sf_dir), by=BY)


# --------------------------------------------------------------------------
# A1 club summary, A2 face variance, A4 fused deliverables
# --------------------------------------------------------------------------
def _spec_sql(spec) -> str:
    fn = {"mean": "avg", "std": "stddev_samp"}
    return ",\n  ".join(f"{r6(f'{fn[stat]}({src})')} AS {out}" for out, src, stat in spec)


_BIAS_SQL = ("CASE WHEN avg(face_to_path) < -0.5 THEN 'Draw bias' "
             "WHEN avg(face_to_path) > 0.5 THEN 'Fade bias' ELSE 'Neutral' END")

_CS_BODY = f"""
SELECT user_id, club_type, count(*) AS shots,
  {_spec_sql(dv.CLUB_SUMMARY_SPEC)}
FROM shots GROUP BY user_id, club_type"""
_CLUB_SUMMARY_ORACLE = with_shots(_CS_BODY)

_FV_BODY = f"""
SELECT user_id, club_type, count(*) AS shots,
  {_spec_sql(dv.FACE_VARIANCE_SPEC)},
  {_BIAS_SQL} AS shape_bias
FROM shots GROUP BY user_id, club_type"""
_FACE_VARIANCE_ORACLE = with_shots(_FV_BODY)

_FUSED_ORACLE = with_shots(f"""
SELECT cs.*, fv.avg_club_path_deg, fv.avg_club_face_deg, fv.avg_face_to_path_deg,
  fv.std_face_to_path_deg, fv.shape_bias, ca.p10_carry_yd, ca.p50_carry_yd, ca.p90_carry_yd
FROM ({_CS_BODY}) cs
JOIN ({_FV_BODY}) fv
  ON cs.user_id = fv.user_id AND cs.club_type IS NOT DISTINCT FROM fv.club_type
JOIN ({_CARRY_BODY}) ca
  ON cs.user_id = ca.user_id AND cs.club_type IS NOT DISTINCT FROM ca.club_type""")


@register("club_summary", _CLUB_SUMMARY_ORACLE)
def q_club_summary(spark, sf_dir):
    return dv.club_summary(testdata.shots(spark, sf_dir), by=BY)


@register("face_variance", _FACE_VARIANCE_ORACLE)
def q_face_variance(spark, sf_dir):
    return dv.face_variance(testdata.shots(spark, sf_dir), by=BY)


@register("all_deliverables_fused", _FUSED_ORACLE)
def q_all_deliverables_fused(spark, sf_dir):
    return dv.fused_deliverables(testdata.shots(spark, sf_dir), by=BY)


# --------------------------------------------------------------------------
# F8/F15 decomposition, F16/F17 labels, A5/A6 shape summary
# --------------------------------------------------------------------------
_SCF_SQL = """
sc AS (
  SELECT *, carry_distance * tan(radians(launch_direction)) AS start_yards,
    carry_deviation_distance AS finish_x, carry_distance AS finish_y,
    carry_deviation_distance - carry_distance * tan(radians(launch_direction)) AS curve_yards
  FROM shots
  WHERE club_type IS NOT NULL AND carry_distance IS NOT NULL
    AND carry_deviation_distance IS NOT NULL AND launch_direction IS NOT NULL)"""

_CURVE_DIR_SQL = ("(CASE WHEN curve_yards < -2.0 THEN 'Draw' WHEN curve_yards > 2.0 THEN 'Fade' "
                  "ELSE 'Straight' END)")
_SHAPE_SQL = f"""CASE
    WHEN start_yards IS NULL OR curve_yards IS NULL OR isnan(start_yards) OR isnan(curve_yards) THEN 'Unknown'
    WHEN abs(start_yards) <= 2.0 AND abs(curve_yards) <= 2.0 THEN 'Straight'
    WHEN start_yards < -2.0 THEN 'Pull-' || {_CURVE_DIR_SQL}
    WHEN start_yards > 2.0 THEN 'Push-' || {_CURVE_DIR_SQL}
    ELSE 'Center-' || {_CURVE_DIR_SQL} END"""
_LAB_SQL = f"lab AS (SELECT *, {_SHAPE_SQL} AS shape FROM sc)"


def _all_cols_sql(extra: list[str]) -> str:
    from shotspark.schema import METRICS
    cols = ["user_id", "session_id", "club_type"] + [r6(m) + f" AS {m}" for m in METRICS]
    return ", ".join(cols + [r6(e) + f" AS {e}" for e in extra])


_DERIVED = ["start_yards", "finish_x", "finish_y", "curve_yards"]


@register("start_curve_finish",
          with_shots(f"SELECT {_all_cols_sql(_DERIVED)} FROM sc", _SCF_SQL))
def q_start_curve_finish(spark, sf_dir):
    return sh.start_curve_finish(testdata.shots(spark, sf_dir))


@register("shape_labels",
          with_shots(f"SELECT {_all_cols_sql(_DERIVED)}, shape FROM lab", _SCF_SQL, _LAB_SQL))
def q_shape_labels(spark, sf_dir):
    return sh.shape_labels(sh.start_curve_finish(testdata.shots(spark, sf_dir)))


_SHAPE_SUMMARY_ORACLE = with_shots(f"""
SELECT a.user_id, a.club_type, a.shots, m.shape AS most_common_shape,
  {r6(rnd('a.s', 2))} AS avg_start_yards, {r6(rnd('a.c', 2))} AS avg_curve_yards,
  {r6(rnd('a.f', 2))} AS avg_finish_yards, {r6(rnd('a.fs', 2))} AS finish_std_yards
FROM agg a JOIN md m ON a.user_id = m.user_id AND a.club_type = m.club_type""",
    _SCF_SQL, _LAB_SQL,
    """agg AS (SELECT user_id, club_type, count(*) AS shots, avg(start_yards) AS s,
       avg(curve_yards) AS c, avg(finish_x) AS f, stddev_samp(finish_x) AS fs
     FROM lab GROUP BY user_id, club_type)""",
    """md AS (SELECT user_id, club_type, shape FROM (
       SELECT user_id, club_type, shape, row_number() OVER (
         PARTITION BY user_id, club_type ORDER BY n DESC, shape) AS rn
       FROM (SELECT user_id, club_type, shape, count(*) AS n FROM lab GROUP BY ALL)) WHERE rn = 1)""")


@register("shape_summary", _SHAPE_SUMMARY_ORACLE)
def q_shape_summary(spark, sf_dir):
    return sh.shape_summary(sh.start_curve_finish(testdata.shots(spark, sf_dir)), by=BY)


# --------------------------------------------------------------------------
# W1 API wind table, A7 extremes, R1 wind long form
# --------------------------------------------------------------------------
def _q(name: str) -> str:
    return '"' + name + '"'


_W1_CTE = ("w1 AS (SELECT user_id, club_type, b AS base, "
           + ", ".join(f"{rnd(f'b * {dbl(1 + f)}', 1)} AS {_q(n)}" for n, f in WIND_FACTORS)
           + f" FROM (SELECT user_id, club_type, {rnd('avg(carry_distance)', 1)} AS b "
             "FROM shots GROUP BY user_id, club_type))")

_W1_ORACLE = with_shots(
    f"SELECT user_id, club_type, {r6('base')} AS {_q(BASE_CARRY)}, "
    + ", ".join(f"{r6(_q(n))} AS {_q(n)}" for n, _ in WIND_FACTORS) + " FROM w1", _W1_CTE)


@register("avg_carry_wind", _W1_ORACLE)
def q_avg_carry_wind(spark, sf_dir):
    return wd.avg_carry_wind(testdata.shots(spark, sf_dir), by=BY)


_EXTREMES_ORACLE = with_shots(f"""
SELECT u.user_id, {r6('u.hi')} AS longest_value, l.club_type AS longest_club,
  {r6('u.lo')} AS shortest_value, s.club_type AS shortest_club
FROM (SELECT user_id, max(base) AS hi, min(base) AS lo FROM w1 GROUP BY user_id) u
LEFT JOIN (SELECT user_id, club_type FROM (SELECT user_id, club_type, row_number() OVER (
    PARTITION BY user_id ORDER BY base DESC, club_type ASC NULLS LAST) AS rn
  FROM w1 WHERE base IS NOT NULL) WHERE rn = 1) l ON l.user_id = u.user_id
LEFT JOIN (SELECT user_id, club_type FROM (SELECT user_id, club_type, row_number() OVER (
    PARTITION BY user_id ORDER BY base ASC, club_type ASC NULLS LAST) AS rn
  FROM w1 WHERE base IS NOT NULL) WHERE rn = 1) s ON s.user_id = u.user_id""", _W1_CTE)


@register("carry_extremes", _EXTREMES_ORACLE)
def q_carry_extremes(spark, sf_dir):
    return dv.carry_extremes(wd.avg_carry_wind(testdata.shots(spark, sf_dir), by=BY),
                             by=BY, value=BASE_CARRY)


_WIND_LONG_ORACLE = with_shots("\nUNION ALL\n".join(
    [f"SELECT user_id, club_type, '{BASE_CARRY}' AS wind_condition, {r6('base')} AS value FROM w1"]
    + [f"SELECT user_id, club_type, '{n}' AS wind_condition, {r6(_q(n))} AS value FROM w1"
       for n, _ in WIND_FACTORS]), _W1_CTE)


@register("wind_long", _WIND_LONG_ORACLE)
def q_wind_long(spark, sf_dir):
    return rs.wind_long(wd.avg_carry_wind(testdata.shots(spark, sf_dir), by=BY), by=BY)


# --------------------------------------------------------------------------
# A12 performance means, R2 long form, R3/O7 ranking
# --------------------------------------------------------------------------
_PERF_CTE = ("perf AS (" + "\nUNION ALL\n".join(
    f"SELECT user_id, club_type, '{label}' AS metric, avg({src}) AS value FROM shots "
    "WHERE club_type IS NOT NULL GROUP BY user_id, club_type"
    for src, label in PERFORMANCE_METRICS) + ")")


@register("performance_long", with_shots(
    f"SELECT user_id, club_type, metric, {r6('value')} AS value FROM perf", _PERF_CTE))
def q_performance_long(spark, sf_dir):
    return rs.metric_long(rs.performance_means(testdata.shots(spark, sf_dir), by=BY), by=BY)


@register("performance_ranked", with_shots(
    f"SELECT user_id, club_type, metric, {r6('value')} AS value, rank() OVER ("
    "PARTITION BY user_id, metric ORDER BY value DESC NULLS LAST) AS rank FROM perf", _PERF_CTE))
def q_performance_ranked(spark, sf_dir):
    return rs.performance_chart_data(testdata.shots(spark, sf_dir), by=BY, metric=None)


# --------------------------------------------------------------------------
# A8-A11, R4-R7 dispersion
# --------------------------------------------------------------------------
_LO, _HI = ds.corridor_bounds()


@register("finish_corridor", with_shots(f"""
SELECT user_id, {r6(f'quantile_cont(finish_x, {_LO!r})')} AS corridor_lower,
  {r6(f'quantile_cont(finish_x, {_HI!r})')} AS corridor_upper,
  {r6(f'quantile_cont(finish_x, {_HI!r}) - quantile_cont(finish_x, {_LO!r})')} AS corridor_width,
  {r6('avg(finish_x)')} AS mean_x
FROM sc GROUP BY user_id""", _SCF_SQL))
def q_finish_corridor(spark, sf_dir):
    return ds.corridor(sh.start_curve_finish(testdata.shots(spark, sf_dir)), "finish_x", by=BY)


_ELL_CTE = """ell AS (
  SELECT *, 4.0 * sqrt(greatest((var_x + var_y) / 2 + sqrt(pow((var_x - var_y) / 2, 2) + pow(cov_xy, 2)), 0.0)) AS width,
    4.0 * sqrt(greatest((var_x + var_y) / 2 - sqrt(pow((var_x - var_y) / 2, 2) + pow(cov_xy, 2)), 0.0)) AS height,
    0.5 * atan2(2 * cov_xy, var_x - var_y) AS theta
  FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, avg(finish_x) AS mean_x, avg(finish_y) AS mean_y,
      var_samp(finish_x) AS var_x, var_samp(finish_y) AS var_y, covar_samp(finish_x, finish_y) AS cov_xy
    FROM sc WHERE isfinite(finish_x) AND isfinite(finish_y) GROUP BY user_id HAVING count(*) >= 3))"""


_ELL_COLS = ["mean_x", "mean_y", "var_x", "var_y", "cov_xy", "width", "height", "theta"]
# The fixture's variances are fractions of a power of two, so many lie exactly between
# two sixth decimals, where the last bit of a sum would decide.  Results are compared in
# steps of 2^-20 (about 1e-6), on which such fractions lie.
_GRID = float(1 << 20)


@register("finish_ellipse", with_shots(
    "SELECT user_id, CAST(n AS BIGINT) AS n, "
    + ", ".join(f"{r6(f'round_even({c} * {_GRID}, 0) / {_GRID}')} AS {c}" for c in _ELL_COLS)
    + " FROM ell", _SCF_SQL, _ELL_CTE))
def q_finish_ellipse(spark, sf_dir):
    ell = ds.ellipse(sh.start_curve_finish(testdata.shots(spark, sf_dir)), by=BY)
    return ell.withColumns({c: F.rint(F.col(c) * F.lit(_GRID)) / F.lit(_GRID) for c in _ELL_COLS})


_STEP = 2 * math.pi / (ELLIPSE_POINTS - 1)
_T_SQL = f"(CASE WHEN r.i = {ELLIPSE_POINTS - 1} THEN {dbl(2 * math.pi)} ELSE CAST(r.i AS DOUBLE) * {dbl(_STEP)} END)"


@register("finish_ellipse_path", with_shots(f"""
SELECT user_id, i,
  {r6('mean_x + (width / 2) * cos(t) * cos(theta) - (height / 2) * sin(t) * sin(theta)')} AS x,
  {r6('mean_y + (width / 2) * cos(t) * sin(theta) + (height / 2) * sin(t) * cos(theta)')} AS y,
  {r6('t')} AS t
FROM (SELECT e.*, r.i, {_T_SQL} AS t FROM ell e CROSS JOIN range({ELLIPSE_POINTS}) r(i))""",
    _SCF_SQL, _ELL_CTE))
def q_finish_ellipse_path(spark, sf_dir):
    ell = ds.ellipse(sh.start_curve_finish(testdata.shots(spark, sf_dir)), by=BY)
    return ds.ellipse_path(ell, by=BY)


@register("dispersion_points", with_shots(
    f"SELECT user_id, club_type, {r6('finish_x')} AS finish_x, {r6('finish_y')} AS finish_y FROM sc", _SCF_SQL))
def q_dispersion_points(spark, sf_dir):
    return ds.dispersion_points(sh.start_curve_finish(testdata.shots(spark, sf_dir)), by=BY)


_CELL_SQL = ("CASE WHEN isfinite(finish_x) AND isfinite(finish_y) "
             "THEN CAST(floor(CAST({} AS DOUBLE) / CAST(5.0 AS DOUBLE)) AS BIGINT) END")


@register("dispersion_binned", with_shots(f"""
SELECT user_id, cell_x, cell_y, count(*) AS shots, {r6('(cell_x + 0.5) * 5.0')} AS mid_x,
  {r6('(cell_y + 0.5) * 5.0')} AS mid_y, count(*) FILTER (cell_x IS NOT NULL) > 0 AS shown
FROM (SELECT user_id, {_CELL_SQL.format('finish_x')} AS cell_x, {_CELL_SQL.format('finish_y')} AS cell_y FROM sc)
GROUP BY user_id, cell_x, cell_y""", _SCF_SQL))
def q_dispersion_binned(spark, sf_dir):
    """The point shown is picked by a hash that SQL lacks: the query tells whether it lies in its cell."""
    cells = ds.binned_points(sh.start_curve_finish(testdata.shots(spark, sf_dir)), by=BY)
    inside = [F.floor(F.col(f"shown_{a}") / F.lit(5.0)) == F.col(f"cell_{a}") for a in "xy"]
    return (cells.withColumn("shown", F.coalesce(inside[0] & inside[1], F.lit(False)))
            .drop("shown_x", "shown_y"))


@register("start_vs_curve_points", with_shots(
    f"SELECT user_id, club_type, {r6('start_yards')} AS start_yards, {r6('curve_yards')} AS curve_yards FROM sc",
    _SCF_SQL))
def q_start_vs_curve_points(spark, sf_dir):
    return ds.start_vs_curve_points(sh.start_curve_finish(testdata.shots(spark, sf_dir)), by=BY)


@register("club_dispersion", with_shots(f"""
SELECT s.user_id, s.club_type, {r6('s.carry_deviation_distance')} AS carry_deviation_distance,
  {r6('s.carry_distance')} AS carry_distance, {r6('m.mc')} AS mean_carry
FROM shots s JOIN (SELECT user_id, club_type, avg(carry_distance) AS mc FROM shots
  WHERE club_type IS NOT NULL GROUP BY user_id, club_type) m
  ON s.user_id = m.user_id AND s.club_type = m.club_type"""))
def q_club_dispersion(spark, sf_dir):
    return ds.club_dispersion(testdata.shots(spark, sf_dir), by=BY)


# --------------------------------------------------------------------------
# Notebook script path: F4-F7 cleaning, A13-A16, W2-W4, J1, O6
# --------------------------------------------------------------------------
_INT_METRICS = [m for m in METRICS if m != "smash_factor"]
_CLEAN_CTE = ("clean AS (SELECT user_id, session_id, club_type, "
              + ", ".join(f"CAST(trunc(coalesce({m}, 0)) AS BIGINT) AS {m}" for m in _INT_METRICS)
              + f", {rnd('smash_factor', 2)} AS smash_factor FROM shots "
              "WHERE club_type IS NOT NULL AND smash_factor IS NOT NULL)")


def _script_shots(spark, sf_dir):
    return cl.script_clean(testdata.shots(spark, sf_dir))


@register("script_clean", with_shots(
    "SELECT user_id, session_id, club_type, " + ", ".join(_INT_METRICS)
    + f", {r6('smash_factor')} AS smash_factor FROM clean", _CLEAN_CTE))
def q_script_clean(spark, sf_dir):
    return _script_shots(spark, sf_dir)


@register("script_club_means", with_shots(
    "SELECT user_id, club_type, " + ", ".join(f"{r6(f'avg({c})')} AS {c}" for c in SCRIPT_MEAN_COLUMNS)
    + f", {r6(rnd('avg(carry_distance)', 2))} AS avg_carry_yds FROM clean GROUP BY user_id, club_type",
    _CLEAN_CTE))
def q_script_club_means(spark, sf_dir):
    return gp.club_means(_script_shots(spark, sf_dir), by=BY)


@register("script_wind_pct", with_shots(
    f"SELECT user_id, club_type, {r6(rnd('avg(carry_distance)', 1))} AS {_q(BASE_CARRY)}, "
    + ", ".join(f"{r6(rnd(f'avg(carry_distance) * {dbl(k)}', 1))} AS {_q(n)}" for n, k in SCRIPT_WIND_MULTIPLIERS)
    + " FROM clean GROUP BY user_id, club_type", _CLEAN_CTE))
def q_script_wind_pct(spark, sf_dir):
    return wd.script_wind_pct(_script_shots(spark, sf_dir), by=BY)


@register("script_headwind_yards", with_shots(
    "SELECT user_id, club_type, "
    + ", ".join(f"{r6(f'avg(carry_distance) * {dbl(k)}')} AS {_q(n)}" for n, k in SCRIPT_HEADWIND_PENALTY)
    + " FROM clean GROUP BY user_id, club_type", _CLEAN_CTE))
def q_script_headwind_yards(spark, sf_dir):
    return wd.script_headwind_yards(_script_shots(spark, sf_dir), by=BY)


@register("script_tailwind_yards", with_shots(
    f"SELECT user_id, club_type, {r6(f'avg(carry_distance) - {dbl(SCRIPT_TAILWIND_SUBTRACT)}')} AS {_q('0 to 5mph')}"
    " FROM clean GROUP BY user_id, club_type", _CLEAN_CTE))
def q_script_tailwind_yards(spark, sf_dir):
    return wd.script_tailwind_yards(_script_shots(spark, sf_dir), by=BY)


@register("ideal_gap", with_shots(
    f"SELECT user_id, {r6(rnd(f'avg(CASE WHEN club_type = {chr(39)}7i{chr(39)} THEN club_speed END) / 10.0', 2))}"
    " AS ideal_gap_yds FROM clean GROUP BY user_id", _CLEAN_CTE))
def q_ideal_gap(spark, sf_dir):
    return gp.ideal_gap(_script_shots(spark, sf_dir), by=BY)


_CODES_SQL = ", ".join(f"'{c}'" for _, c, _ in CLUBS)
_EDGES_SQL = ", ".join(f"('{g}', '{a}', '{b}')" for g, a, b in GAP_EDGES)


@register("yardage_gaps", with_shots(f"""
SELECT u.user_id, e.gap, e.shorter, e.longer, {r6('l.mc - s.mc')} AS gap_yds,
  {r6(rnd('l.mc - s.mc', 0))} AS gap_yds_display
FROM (SELECT DISTINCT user_id FROM clean WHERE club_type IN ({_CODES_SQL})) u
CROSS JOIN (VALUES {_EDGES_SQL}) e(gap, shorter, longer)
LEFT JOIN m s ON s.user_id = u.user_id AND s.club_type = e.shorter
LEFT JOIN m l ON l.user_id = u.user_id AND l.club_type = e.longer""", _CLEAN_CTE,
    "m AS (SELECT user_id, club_type, avg(carry_distance) AS mc FROM clean GROUP BY user_id, club_type)"))
def q_yardage_gaps(spark, sf_dir):
    return gp.yardage_gaps(_script_shots(spark, sf_dir), by=BY)


_POS_SQL = "CASE club_type " + " ".join(f"WHEN '{c}' THEN {p}" for p, c, _ in CLUBS) + " END"


@register("bag_order_table", with_shots(
    f"SELECT user_id, club_type, CAST({_POS_SQL} AS BIGINT) AS pos, "
    f"{r6(rnd(rnd('avg(carry_distance)', 1), 0))} AS {_q(BASE_CARRY)}, "
    + ", ".join(f"{r6(rnd(rnd(f'avg(carry_distance) * {dbl(k)}', 1), 0))} AS {_q(n)}"
                for n, k in SCRIPT_WIND_MULTIPLIERS)
    + " FROM clean GROUP BY user_id, club_type", _CLEAN_CTE))
def q_bag_order_table(spark, sf_dir):
    return gp.bag_order(wd.script_wind_pct(_script_shots(spark, sf_dir), by=BY), by=BY)


# --------------------------------------------------------------------------
# F20 distinct clubs, F21 profile
# --------------------------------------------------------------------------
@register("clubs_distinct", with_shots(
    "SELECT DISTINCT user_id, club_type FROM shots WHERE club_type IS NOT NULL"))
def q_clubs_distinct(spark, sf_dir):
    return cl.clubs_distinct(testdata.shots(spark, sf_dir), by=BY)


_PROFILE_TYPES = [("user_id", "bigint"), ("session_id", "bigint"), ("club_type", "string")] + \
    [(m, "double") for m in METRICS]


@register("shots_profile", with_shots("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, '{t}' AS dtype FROM shots"
    for c, t in _PROFILE_TYPES)))
def q_shots_profile(spark, sf_dir):
    return cl.profile(testdata.shots(spark, sf_dir))


# --------------------------------------------------------------------------
# Tables: K1-K8, K12-K13, S8-S11, J2 (tables built from the views in the
# session's checkpoint folder, one fresh root per call)
# --------------------------------------------------------------------------
def _scratch(spark, name: str) -> str:
    import uuid
    from shotspark.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/shotspark-{name}-{uuid.uuid4().hex[:12]}"


def build_tables(spark, sf_dir, name: str) -> tb.Tables:
    """Load the shots and sessions views into a fresh set of tables."""
    tables = tb.Tables(spark, _scratch(spark, name))
    sessions = testdata.sessions(spark, sf_dir).select(
        F.col("id").cast("string"), F.col("user_id").cast("string"), "filename", "storage_path",
        F.col("uploaded_at").cast("timestamp"))
    ingest_frame(tables, tb.shots_from_view(testdata.shots(spark, sf_dir)), sessions)
    return tables


_CACHE_COLS = ["user_id", "club_type", "shots", "avg_carry_yd", "std_carry_yd", "avg_ball_speed",
               "avg_smash", "avg_club_speed", "avg_launch_deg", "avg_backspin", "shape_bias"]


@register("cached_summary", with_shots(f"""
SELECT CAST(user_id AS VARCHAR) AS user_id, club_type, count(*) AS shots,
  {r6('avg(carry_distance)')} AS avg_carry_yd, {r6('stddev_samp(carry_distance)')} AS std_carry_yd,
  {r6('avg(ball_speed)')} AS avg_ball_speed, {r6('avg(smash_factor)')} AS avg_smash,
  {r6('avg(club_speed)')} AS avg_club_speed, {r6('avg(launch_angle)')} AS avg_launch_deg,
  {r6('avg(backspin)')} AS avg_backspin, CAST(NULL AS VARCHAR) AS shape_bias
FROM shots GROUP BY user_id, club_type"""))
def q_cached_summary(spark, sf_dir):
    tables = build_tables(spark, sf_dir, "cache")
    tb.generate(tables)
    return tb.cached_summary(tables).select(*_CACHE_COLS)


_KEYED_SHOT_COLS = ("CAST(user_id AS VARCHAR) AS user_id, CAST(session_id AS VARCHAR) AS session_id, club_type, "
                    + ", ".join(f"{r6(m)} AS {m}" for m in METRICS))


def _live_shots(tables):
    return tables.shots().select("user_id", "session_id", "club_type", *METRICS)


@register("after_delete_session", with_shots(
    f"SELECT {_KEYED_SHOT_COLS} FROM shots WHERE session_id NOT IN "
    "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"))
def q_after_delete_session(spark, sf_dir):
    """Delete every urgent-priority session (a data-derived request set),
    compact, read back: the compacted table equals the anti-join."""
    tables = build_tables(spark, sf_dir, "delete")
    dead = (testdata.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
            .select(F.col("o_orderkey").cast("string").alias("session_id")))
    tables.delete_sessions(dead)
    tables.compact()
    return _live_shots(tables)


@register("after_erase_user", with_shots(
    f"SELECT {_KEYED_SHOT_COLS} FROM shots WHERE user_id NOT IN "
    "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"))
def q_after_erase_user(spark, sf_dir):
    """Erase every building-segment customer (tombstones, read-time anti-join)."""
    tables = build_tables(spark, sf_dir, "erase")
    dead = (testdata.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
            .select(F.col("c_custkey").cast("string").alias("user_id")))
    tables.erase_users(dead)
    return _live_shots(tables)


@register("sessions_list", "WITH " + SESSIONS_CTE + """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(id AS VARCHAR) AS id, filename, uploaded_at FROM sessions""")
def q_sessions_list(spark, sf_dir):
    tables = build_tables(spark, sf_dir, "sessions")
    s = tb.list_sessions(tables)
    return s.withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp_ntz"))


#: Names under which a user uploads again and again.
_REUSED_NAMES = 5


@register("shots_deduped", with_shots(f"""
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(session_id AS VARCHAR) AS session_id, count(*) AS shots,
  {r6('avg(carry_distance)')} AS avg_carry_yd
FROM shots WHERE session_id IN (
  SELECT o_orderkey FROM orders QUALIFY row_number() OVER (
    PARTITION BY o_custkey, o_orderkey % {_REUSED_NAMES}
    ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1)
GROUP BY user_id, session_id"""))
def q_shots_deduped(spark, sf_dir):
    """Shots by session when a file of a name replaces the user's earlier ones of it."""
    tables = tb.Tables(spark, _scratch(spark, "deduped"))
    sessions = testdata.sessions(spark, sf_dir).select(
        F.col("id").cast("string"), F.col("user_id").cast("string"),
        F.format_string("%d.csv", F.col("id").cast("long") % _REUSED_NAMES).alias("filename"), "storage_path",
        F.col("uploaded_at").cast("timestamp"))
    ingest_frame(tables, tb.shots_from_view(testdata.shots(spark, sf_dir)), sessions)
    shots = tb.fetch_shots(tables, dedupe_by=("user_id", "filename"))
    return shots.groupBy("user_id", "session_id").agg(
        F.count("*").alias("shots"), F.avg("carry_distance").alias("avg_carry_yd"))


@register("shots_export", with_shots(
    "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(session_id AS VARCHAR) AS session_id, "
    "club_type AS \"Club Type\", "
    + ", ".join(f"{r6(s)} AS \"{t}\"" for t, s in METRIC_TITLES) + " FROM shots"))
def q_shots_export(spark, sf_dir):
    tables = build_tables(spark, sf_dir, "export")
    return cl.to_title_case(tb.fetch_shots(tables).select("user_id", "session_id", "club_type", *METRICS))


@register("ingest_csv", with_shots(
    "SELECT user_id, session_id, club_type, " + ", ".join(f"{r6(m)} AS {m}" for m in METRICS) + " FROM shots"))
def q_ingest_csv(spark, sf_dir):
    """Shots written as raw session CSVs (two header layouts, units rows,
    BOM, NA markers), read back through the CSV ingest path."""
    dirs = testdata.write_session_csvs(testdata.shots(spark, sf_dir), _scratch(spark, "csv"))
    typed = csvs.read_sessions(spark, dirs, keep=["User Id", "Session Id"])
    return typed.select(F.col("User Id").cast("bigint").alias("user_id"),
                        F.col("Session Id").cast("bigint").alias("session_id"),
                        "club_type", *METRICS)


@register("upload_sessions", with_shots(
    "SELECT CAST(user_id AS VARCHAR) AS user_id, club_type, count(*) AS rows_imported, "
    f"{r6('avg(carry_distance)')} AS avg_carry_yd FROM shots GROUP BY user_id, club_type"))
def q_upload_sessions(spark, sf_dir):
    """Raw session files of all users uploaded in one job, counted
    from the tables (a file of the fixture holds several users' shots, so the
    user comes from its column)."""
    dirs = testdata.write_session_csvs(testdata.shots(spark, sf_dir), _scratch(spark, "upload csv"))
    tables = tb.Tables(spark, _scratch(spark, "upload"))
    upload_sessions(spark, tables, dirs, F.col("user_id"), dt.datetime(2025, 1, 1), keep=("User Id",))
    shots = tables.shots()
    return shots.groupBy("user_id", "club_type").agg(F.count(F.lit(1)).alias("rows_imported"),
                                                     F.avg("carry_distance").alias("avg_carry_yd"))


_SOME_USERS = "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"


@register("generate_some_users", with_shots(f"""
SELECT CAST(user_id AS VARCHAR) AS user_id, club_type, count(*) * (CASE WHEN user_id IN ({_SOME_USERS})
    AND user_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT') THEN 2 ELSE 1 END) AS shots
FROM shots WHERE NOT (user_id IN ({_SOME_USERS}) AND session_id IN (SELECT o_orderkey FROM orders
    WHERE o_orderpriority = '1-URGENT') AND user_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT'))
GROUP BY user_id, club_type"""))
def q_generate_some_users(spark, sf_dir):
    """The cache of all users; then the urgent sessions go, the other
    shots are doubled, and two segments' users are generated anew.  Users of
    those who have no shots left keep their cached rows."""
    tables = build_tables(spark, sf_dir, "some")
    tb.generate(tables)
    orders = testdata.table(spark, sf_dir, "orders")
    tables.delete_sessions(orders.where("o_orderpriority = '1-URGENT'")
                           .select(F.col("o_orderkey").cast("string").alias("session_id")))
    tables.append_shots(tb.shots_from_view(testdata.shots(spark, sf_dir)))
    users = (testdata.table(spark, sf_dir, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')")
             .select(F.col("c_custkey").cast("string").alias("user_id")))
    tb.generate(tables, users=users)
    return tb.cached_summary(tables).select("user_id", "club_type", "shots")


# --------------------------------------------------------------------------
# K9-K11, S6, S7 CSV results; F14, F19, R3
# --------------------------------------------------------------------------
@register("deliverables_csv", _CLUB_SUMMARY_ORACLE)
def q_deliverables_csv(spark, sf_dir):
    """The deliverables written as CSV and the club summary loaded again by
    its name in the registry."""
    from shotspark.sources import sinks
    found = dv.deliverables(testdata.shots(spark, sf_dir), by=BY, materialize=True)
    paths = sinks.save_deliverables(found, _scratch(spark, "csv out"))
    back = sinks.load(spark, "club_summary", path=paths["club_summary"])
    types = dict(found.club_summary.dtypes)
    return back.select(*[F.col(c).cast(types[c]).alias(c) for c in back.columns])


@register("face_variance_derived", with_shots(_FV_BODY.replace("FROM shots", "FROM derived"),
          "derived AS (SELECT * REPLACE (club_face - club_path AS face_to_path) FROM shots)"))
def q_face_variance_derived(spark, sf_dir):
    """Shots without a face-to-path column: it is the difference of two others."""
    return dv.face_variance(testdata.shots(spark, sf_dir).drop("face_to_path"), by=BY)


@register("one_club_shots", with_shots(
    "SELECT user_id, session_id, club_type, " + ", ".join(f"{r6(m)} AS {m}" for m in METRICS)
    + " FROM shots WHERE club_type = '7i'"))
def q_one_club_shots(spark, sf_dir):
    """The choice of a club is the feature; all users' shots with it."""
    return cl.for_club(testdata.shots(spark, sf_dir), "7i")


_ONE_METRIC = PERFORMANCE_METRICS[0][1]


@register("performance_one_metric", with_shots(
    f"SELECT user_id, club_type, metric, {r6('value')} AS value, rank() OVER ("
    "PARTITION BY user_id, metric ORDER BY value DESC NULLS LAST) AS rank FROM perf "
    f"WHERE metric = '{_ONE_METRIC}'", _PERF_CTE))
def q_performance_one_metric(spark, sf_dir):
    return rs.performance_chart_data(testdata.shots(spark, sf_dir), by=BY, metric=_ONE_METRIC)


# --------------------------------------------------------------------------
# A3, A5, A8 for groups of any size: ranks and counts instead of maps per group
# --------------------------------------------------------------------------
@register("carry_averages_ranked", _CARRY_ORACLE)
def q_carry_averages_ranked(spark, sf_dir):
    return dv.carry_averages(testdata.shots(spark, sf_dir), by=BY, ranked=True)


@register("club_carry_all_users", with_shots(
    _CARRY_BODY.replace("SELECT user_id, club_type", "SELECT club_type").replace("GROUP BY user_id, club_type", "GROUP BY club_type")))
def q_club_carry_all_users(spark, sf_dir):
    """One group per club over all users' shots."""
    return dv.carry_averages(testdata.shots(spark, sf_dir), ranked=True)


@register("finish_corridor_all_users", with_shots(f"""
SELECT {r6(f'quantile_cont(finish_x, {_LO!r})')} AS corridor_lower,
  {r6(f'quantile_cont(finish_x, {_HI!r})')} AS corridor_upper,
  {r6(f'quantile_cont(finish_x, {_HI!r}) - quantile_cont(finish_x, {_LO!r})')} AS corridor_width,
  {r6('avg(finish_x)')} AS mean_x FROM sc""", _SCF_SQL))
def q_finish_corridor_all_users(spark, sf_dir):
    """One group: the corridor of all shots."""
    return ds.corridor(sh.start_curve_finish(testdata.shots(spark, sf_dir)), "finish_x", ranked=True)


@register("club_mode_carry", with_shots(f"""
SELECT club_type, {r6('carry_distance')} AS mode_carry_distance FROM (
  SELECT club_type, carry_distance, row_number() OVER (PARTITION BY club_type ORDER BY (carry_distance IS NULL), n DESC, carry_distance) AS rn
  FROM (SELECT club_type, carry_distance, count(*) AS n FROM shots GROUP BY ALL)) WHERE rn = 1"""))
def q_club_mode_carry(spark, sf_dir):
    return sh.mode_of(testdata.shots(spark, sf_dir), "carry_distance", by=("club_type",), counted=True)


# --------------------------------------------------------------------------
# Order as a column
# --------------------------------------------------------------------------
@register("shape_summary_ordered", _SHAPE_SUMMARY_ORACLE.replace(
    "SELECT a.user_id, a.club_type,",
    "SELECT row_number() OVER (PARTITION BY a.user_id ORDER BY a.shots DESC, a.club_type) - 1 AS position, a.user_id, a.club_type,"))
def q_shape_summary_ordered(spark, sf_dir):
    """O1: each user's clubs, most shots first, then by name."""
    out = sh.shape_summary(sh.start_curve_finish(testdata.shots(spark, sf_dir)), by=BY)
    return od.positions(out, [F.desc("shots"), F.asc("club_type")], within=BY)


@register("cached_summary_ordered", with_shots("""
SELECT CAST(user_id AS VARCHAR) AS user_id, club_type, n AS shots,
  row_number() OVER (PARTITION BY user_id ORDER BY club_type ASC NULLS LAST) - 1 AS position
FROM (SELECT user_id, club_type, count(*) AS n FROM shots GROUP BY user_id, club_type)"""))
def q_cached_summary_ordered(spark, sf_dir):
    """The cached summary with the place of each club, the NULL club last."""
    tables = build_tables(spark, sf_dir, "cache order")
    tb.generate(tables)
    out = tb.cached_summary(tables).select("user_id", "club_type", "shots")
    return od.positions(out, [F.asc_nulls_last("club_type")], within=("user_id",))


@register("sessions_list_ordered", "WITH " + SESSIONS_CTE + """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(id AS VARCHAR) AS id,
  row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC, CAST(id AS VARCHAR)) - 1 AS position FROM sessions""")
def q_sessions_list_ordered(spark, sf_dir):
    """O3: each user's sessions, newest first."""
    out = tb.list_sessions(build_tables(spark, sf_dir, "sessions order")).select("user_id", "id", "uploaded_at")
    return od.positions(out, [F.desc("uploaded_at"), F.asc("id")], within=("user_id",)).drop("uploaded_at")


_MERGED_ORDER = ["user_id", "session_id", "club_type", *METRICS]


@register("merged_shots_csv", with_shots(
    "SELECT row_number() OVER (ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in _MERGED_ORDER) + ") - 1 AS row_index, "
    "user_id, session_id, club_type, " + ", ".join(f"{r6(m)} AS {m}" for m in METRICS) + " FROM shots"))
def q_merged_shots_csv(spark, sf_dir):
    """All shots merged into one CSV with its row index, read back."""
    from shotspark.sources import sinks
    path = sinks.write_merged_csv(testdata.shots(spark, sf_dir), _scratch(spark, "merged"),
                                  [F.asc_nulls_first(c) for c in _MERGED_ORDER], options=sinks.GZIP)
    back = sinks.read_csv_table(spark, path, infer=False)
    return back.select(*[F.col(c).cast("bigint").alias(c) for c in ("row_index", "user_id", "session_id")], "club_type",
                       *[F.col(m).cast("double").alias(m) for m in METRICS])


# --------------------------------------------------------------------------
# S3 limit, K1 landing, A17 counts while writing, S9 reads of one user
# --------------------------------------------------------------------------
_FIRST_FILES = 10


@register("ingest_first_files", with_shots(
    "SELECT user_id, session_id, club_type, " + ", ".join(f"{r6(m)} AS {m}" for m in METRICS)
    + f""" FROM shots WHERE session_id IN (SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN (
    SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    ORDER BY m LIMIT {_FIRST_FILES}))"""))
def q_ingest_first_files(spark, sf_dir):
    """The first files by path (the limit is the feature); a file holds the
    sessions of a month."""
    path = _scratch(spark, "months")
    month = testdata.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    titles = dict((s, t) for t, s in METRIC_TITLES) | {"user_id": "User Id", "session_id": "Session Id", "club_type": "Club Type"}
    out = testdata.shots(spark, sf_dir).join(month, "session_id").withColumnsRenamed(titles)
    out.repartition(84, "month").write.partitionBy("month").option("header", True).csv(path)
    typed = csvs.read_sessions(spark, path, limit=_FIRST_FILES, keep=["User Id", "Session Id"])
    return typed.select(F.col("User Id").cast("bigint").alias("user_id"),
                        F.col("Session Id").cast("bigint").alias("session_id"), "club_type", *METRICS)


@register("landing_latest", with_shots(
    "SELECT user_id, session_id, club_type, CASE WHEN user_id % 2 = 1 THEN carry_distance + 1 ELSE carry_distance END AS carry_distance "
    "FROM shots"))
def q_landing_latest(spark, sf_dir):
    """K1: raw files landed, the files of odd users landed again under the same paths
    with other carries; the shots of the latest versions."""
    from shotspark.sources.landing import Landing
    dirs = testdata.write_session_csvs(testdata.shots(spark, sf_dir), _scratch(spark, "land"))
    landing = Landing(spark, _scratch(spark, "landed"))
    landing.land(csvs.session_files(spark, dirs), dt.datetime(2025, 1, 1), batch="first")
    more = testdata.shots(spark, sf_dir).where("user_id % 2 = 1").withColumn("carry_distance", F.col("carry_distance") + 1)
    again = csvs.session_files(spark, testdata.write_session_csvs(more, _scratch(spark, "land again"))[1])
    # The second upload's files take the paths of the first one's, number by number.
    old = od.positions(csvs.session_files(spark, dirs[1]).select(csvs.SOURCE), [F.asc(csvs.SOURCE)]).withColumnRenamed(csvs.SOURCE, "to")
    new = od.positions(again.select(csvs.SOURCE), [F.asc(csvs.SOURCE)])
    spare = F.coalesce("to", csvs.SOURCE).alias("storage_path")
    names = counted(new.join(old, "position", "full").select(csvs.SOURCE, "to"))
    moved = again.join(names, csvs.SOURCE).select(spare, "content").unionByName(
        names.where(F.col(csvs.SOURCE).isNull()).select(spare, F.lit(b"").alias("content")))
    landing.land(moved, dt.datetime(2025, 1, 2), batch="second")
    files = landing.latest().withColumnRenamed("storage_path", csvs.SOURCE)
    shots = csvs.shots_of_files(files, ["User Id", "Session Id"])
    return shots.select(F.col("User Id").cast("bigint").alias("user_id"), F.col("Session Id").cast("bigint").alias("session_id"),
                        "club_type", "carry_distance")


@register("observed_counts", with_shots("""
SELECT (SELECT count(*) FROM shots) AS rows_imported,
  (SELECT count(*) FROM (SELECT DISTINCT user_id, club_type FROM shots)) AS clubs_computed"""))
def q_observed_counts(spark, sf_dir):
    """The counts that upload and cache generation return, taken while writing."""
    dirs = testdata.write_session_csvs(testdata.shots(spark, sf_dir), _scratch(spark, "counted csv"))
    tables = tb.Tables(spark, _scratch(spark, "counted"))
    done = upload_sessions(spark, tables, dirs, F.col("user_id"), dt.datetime(2025, 1, 1), keep=("User Id",))
    made = tb.generate(tables)
    return spark.createDataFrame([(done.rows_imported, made.clubs_computed)], "rows_imported long, clubs_computed long")


@register("shots_of_users", with_shots(
    f"SELECT CAST(c_custkey AS VARCHAR) AS asked, c_mktsegment, session_id, club_type, {r6('carry_distance')} AS carry_distance "
    "FROM customer JOIN (SELECT user_id, CAST(session_id AS VARCHAR) AS session_id, club_type, carry_distance FROM shots) "
    "ON user_id = c_custkey"))
def q_shots_of_users(spark, sf_dir):
    """Every customer reads through the table function that shows one user's shots."""
    tables = build_tables(spark, sf_dir, "rls")
    shots_of = tables.register_reads("rls_")[0]
    testdata.table(spark, sf_dir, "customer").createOrReplaceTempView("rls_customer")
    return spark.sql(f"""SELECT c.asked, c.c_mktsegment, s.session_id, s.club_type, s.carry_distance
        FROM (SELECT CAST(c_custkey AS STRING) AS asked, c_mktsegment FROM rls_customer) c, LATERAL {shots_of}(c.asked) s""")


# --------------------------------------------------------------------------
# F11 drop all-NULL columns (data-dependent schema, opt-in)
# --------------------------------------------------------------------------
_CS_NO_SPIN = [s for s in dv.CLUB_SUMMARY_SPEC if s[1] != "spin_axis"]


@register("drop_all_null", with_shots(f"""
SELECT user_id, club_type, count(*) AS shots,
  {_spec_sql(_CS_NO_SPIN)}
FROM shots GROUP BY user_id, club_type"""))
def q_drop_all_null(spark, sf_dir):
    """Club summary over shots whose spin axis was never recorded: the
    all-NULL ``avg_spin_axis_deg`` column is dropped from the result."""
    shots = testdata.shots(spark, sf_dir).withColumn("spin_axis", F.lit(None).cast("double"))
    return dv.drop_all_null(dv.club_summary(shots, by=BY))


# --------------------------------------------------------------------------
# F3 numeric coercion of raw text (S2-style NA markers, padded values, junk)
# --------------------------------------------------------------------------
_COERCE_METRICS = ["carry_distance", "ball_speed", "smash_factor", "spin_axis"]


def _raw_text_spark(m: str):
    x = F.col(m)
    key = F.col("session_id") + F.col("user_id")
    return (F.when(x.isNull(), F.lit("NA"))
            .when(F.pmod(key, F.lit(11)) == 0, F.concat(x.cast("string"), F.lit("d")))
            .when(F.pmod(key, F.lit(13)) == 0, F.concat(F.lit(" "), x.cast("string"), F.lit(" ")))
            .when(F.pmod(key, F.lit(17)) == 0, F.regexp_replace(x.cast("string"), r"\.", ","))
            .otherwise(x.cast("string")).alias(m))


def _raw_text_sql(m: str) -> str:
    return (f"CASE WHEN {m} IS NULL THEN 'NA' "
            f"WHEN (session_id + user_id) % 11 = 0 THEN CAST({m} AS VARCHAR) || 'd' "
            f"WHEN (session_id + user_id) % 13 = 0 THEN ' ' || CAST({m} AS VARCHAR) || ' ' "
            f"WHEN (session_id + user_id) % 17 = 0 THEN replace(CAST({m} AS VARCHAR), '.', ',') "
            f"ELSE CAST({m} AS VARCHAR) END")


_RX_SQL = NUMBER_RX.replace("'", "''")


@register("coerce_numeric", with_shots(
    "SELECT user_id, session_id, "
    + ", ".join(f"{r6(f'CASE WHEN regexp_full_match(t_{m}, {chr(39)}{_RX_SQL}{chr(39)}) THEN TRY_CAST(t_{m} AS DOUBLE) END')} AS {m}"
                for m in _COERCE_METRICS)
    + " FROM (SELECT user_id, session_id, "
    + ", ".join(f"{_raw_text_sql(m)} AS t_{m}" for m in _COERCE_METRICS) + " FROM shots)"))
def q_coerce_numeric(spark, sf_dir):
    """Every shot's metrics as raw text (NA markers, padded values, unit
    suffixes, decimal commas), coerced back: bad text -> NULL."""
    raw = testdata.shots(spark, sf_dir).select("user_id", "session_id",
                                               *[_raw_text_spark(m) for m in _COERCE_METRICS])
    return cl.coerce_numeric(raw, _COERCE_METRICS)
