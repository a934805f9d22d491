"""Schemas, name maps and the small fixed dimensions.

Everything under a "FIXED VALUES" comment must keep these exact values for
results to match the semantics being reproduced (column titles, wind factors,
club names, gap edges, thresholds).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: the 20 numeric shot metrics, as (Title Case, snake_case).
# ---------------------------------------------------------------------------
METRIC_TITLES = [
    ("Club Speed", "club_speed"),
    ("Attack Angle", "attack_angle"),
    ("Club Path", "club_path"),
    ("Club Face", "club_face"),
    ("Face to Path", "face_to_path"),
    ("Ball Speed", "ball_speed"),
    ("Smash Factor", "smash_factor"),
    ("Launch Angle", "launch_angle"),
    ("Launch Direction", "launch_direction"),
    ("Backspin", "backspin"),
    ("Sidespin", "sidespin"),
    ("Spin Rate", "spin_rate"),
    ("Spin Axis", "spin_axis"),
    ("Apex Height", "apex_height"),
    ("Carry Distance", "carry_distance"),
    ("Carry Deviation Angle", "carry_deviation_angle"),
    ("Carry Deviation Distance", "carry_deviation_distance"),
    ("Total Distance", "total_distance"),
    ("Total Deviation Angle", "total_deviation_angle"),
    ("Total Deviation Distance", "total_deviation_distance"),
]
METRICS = [s for _, s in METRIC_TITLES]

CLUB_TITLE = "Club Type"
TITLE_TO_SNAKE = {CLUB_TITLE: "club_type", **{t: s for t, s in METRIC_TITLES}}
SNAKE_TO_TITLE = {s: t for t, s in TITLE_TO_SNAKE.items()}
# Shot columns in file order: club type first, then the 20 metrics.
SHOT_COLUMNS = ["club_type"] + METRICS

# FIXED VALUES: raw-file columns outside the 21 shot columns.
PLAYER_TITLE = "Player"
SCRIPT_DROPPED = ["Club Name", "Note", "Tag", "Relative Humidity"]
# FIXED VALUES: the notebook script's integer-coerced columns (23, in its order).
SCRIPT_INT_COLUMNS = [
    "Club Speed", "Attack Angle", "Club Path", "Club Face", "Face to Path",
    "Ball Speed", "Launch Angle", "Launch Direction", "Backspin", "Sidespin",
    "Spin Rate", "Spin Rate Type", "Spin Axis", "Apex Height", "Carry Distance",
    "Carry Deviation Angle", "Carry Deviation Distance", "Total Distance",
    "Total Deviation Angle", "Total Deviation Distance", "Air Density",
    "Temperature", "Air Pressure",
]

# FIXED VALUES: pandas' default CSV missing-value markers (exact field match).
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# ---------------------------------------------------------------------------
# Table schemas.
# ---------------------------------------------------------------------------
SESSIONS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("storage_path", T.StringType(), False),
    T.StructField("uploaded_at", T.TimestampType(), True),
])

SHOTS_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType(), False),
     T.StructField("session_id", T.StringType(), False),
     T.StructField("user_id", T.StringType(), False),
     T.StructField("club_type", T.StringType(), True)]
    + [T.StructField(m, T.DoubleType(), True) for m in METRICS]
)

# club_summaries cache: (summary column -> cache column), FIXED VALUES.
CACHE_RENAMES = [
    ("club_type", "club_type"),
    ("shots", "shots"),
    ("avg_club_speed_mph", "avg_club_speed"),
    ("avg_ball_speed_mph", "avg_ball_speed"),
    ("avg_smash", "avg_smash"),
    ("avg_launch_deg", "avg_launch_deg"),
    ("avg_carry_yd", "avg_carry_yd"),
    ("std_carry_yd", "std_carry_yd"),
    ("avg_backspin_rpm", "avg_backspin"),
]
CLUB_SUMMARIES_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("computed_at", T.TimestampType(), True),
    T.StructField("club_type", T.StringType(), True),
    T.StructField("shots", T.LongType(), True),
    T.StructField("avg_carry_yd", T.DoubleType(), True),
    T.StructField("std_carry_yd", T.DoubleType(), True),
    T.StructField("avg_ball_speed", T.DoubleType(), True),
    T.StructField("avg_smash", T.DoubleType(), True),
    T.StructField("avg_club_speed", T.DoubleType(), True),
    T.StructField("avg_launch_deg", T.DoubleType(), True),
    T.StructField("avg_backspin", T.DoubleType(), True),
    T.StructField("shape_bias", T.StringType(), True),
])

# ---------------------------------------------------------------------------
# FIXED VALUES: wind model.  Band label -> signed fraction of base carry.
# ---------------------------------------------------------------------------
WIND_FACTORS = [
    ("0 to 5 mph headwind", -0.05),
    ("5 to 10 mph headwind", -0.10),
    ("10 to 20 mph headwind", -0.20),
    ("20 to 30 mph headwind", -0.30),
    ("0 to 5 mph tailwind", 0.02),
    ("5 to 10 mph tailwind", 0.04),
    ("10 to 20 mph tailwind", 0.08),
    ("20 to 30 mph tailwind", 0.12),
]
BASE_CARRY = "Base Carry"
# Script variant multiplies the unrounded mean by these literals.
SCRIPT_WIND_MULTIPLIERS = [
    ("0 to 5 mph headwind", 0.95),
    ("5 to 10 mph headwind", 0.90),
    ("10 to 20 mph headwind", 0.80),
    ("20 to 30 mph headwind", 0.70),
    ("0 to 5 mph tailwind", 1.02),
    ("5 to 10 mph tailwind", 1.04),
    ("10 to 20 mph tailwind", 1.08),
    ("20 to 30 mph tailwind", 1.12),
]
# Script headwind penalty in yards (band -> fraction of mean carry).
SCRIPT_HEADWIND_PENALTY = [("0 to 5mph", 0.05), ("5 to 10mph", 0.10), ("10 to 20mph", 0.20)]
# Script tailwind: subtract half of the 5 mph band midpoint.
SCRIPT_TAILWIND_SUBTRACT = 5 / 2

# FIXED VALUES: shape classifier tolerances and face-bias threshold.
START_TOL = 2.0
CURVE_TOL = 2.0
BIAS_THRESHOLD = 0.5

# ---------------------------------------------------------------------------
# FIXED VALUES: club dimension, long to short: (pos, code, long name).
# ---------------------------------------------------------------------------
CLUBS = [
    (0, "D", "Driver"),
    (1, "3W", "3 Wood"),
    (2, "3H", "3 Hybrid"),
    (3, "3i", "3 Iron"),
    (4, "4i", "4 Iron"),
    (5, "5i", "5 Iron"),
    (6, "6i", "6 Iron"),
    (7, "7i", "7 Iron"),
    (8, "8i", "8 Iron"),
    (9, "9i", "9 Iron"),
    (10, "PW", "Pitching Wedge"),
    (11, "GW", "Gap Wedge"),
    (12, "SW", "Sand Wedge"),
    (13, "LW", "Lob Wedge"),
]
# Extra spellings accepted for a code.
CLUB_ALIASES = [("3hi", "3H"), ("3hy", "3H")]

# FIXED VALUES: yardage gap edges (label, shorter code, longer code).
GAP_EDGES = [
    ("lw_to_sw", "LW", "SW"),
    ("sw_to_gw", "SW", "GW"),
    ("gw_to_pw", "GW", "PW"),
    ("pw_to_nineiron", "PW", "9i"),
    ("nineiron_to_eightiron", "9i", "8i"),
    ("eightiron_to_seveniron", "8i", "7i"),
    ("seveniron_to_sixiron", "7i", "6i"),
    ("sixiron_to_fiveiron", "6i", "5i"),
    ("fiveiron_to_fouriron", "5i", "4i"),
    ("fouriron_to_threeiron", "4i", "3i"),
    ("fouriron_to_threehybrid", "4i", "3H"),
    ("threehybrid_to_threewood", "3H", "3W"),
    ("threeiron_to_threewood", "3i", "3W"),
    ("threewood_to_driver", "3W", "D"),
]
# Club used for the ideal iron gap (mean club speed / 10).
IDEAL_GAP_CLUB = "7i"
IDEAL_GAP_DIVISOR = 10

# FIXED VALUES: the seven performance metrics (source column, chart label).
PERFORMANCE_METRICS = [
    ("club_speed", "Club Speed"),
    ("ball_speed", "Ball Speed"),
    ("apex_height", "Apex Height"),
    ("carry_distance", "Carry Distance"),
    ("total_distance", "Total Distance"),
    ("smash_factor", "Smash Factor"),
    ("spin_rate", "Spin Rate"),
]
DEFAULT_PERFORMANCE_METRIC = "Carry Distance"

# Script mean tables: columns averaged per club (carry first).
SCRIPT_MEAN_COLUMNS = ["carry_distance", "ball_speed", "spin_rate", "apex_height", "club_speed"]

# Dispersion defaults.
CORRIDOR_LEVEL = 0.95
ELLIPSE_SIGMA = 2.0
ELLIPSE_POINTS = 200
ELLIPSE_MIN_POINTS = 3
