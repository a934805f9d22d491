"""Shot decomposition (start / curve / finish), shape labels, shape summary."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.functions.expr import np_round, shape_label
from shotspark.operators.deliverables import require_columns
from shotspark.schema import CURVE_TOL, START_TOL

CLUB = "club_type"
# FIXED VALUES: all shape labels.
SHAPES = ["Center-Draw", "Center-Fade", "Pull-Draw", "Pull-Fade", "Pull-Straight", "Push-Draw", "Push-Fade",
          "Push-Straight", "Straight", "Unknown"]
# Rows missing any of these (when present) are dropped before decomposition.
DECOMPOSE_REQUIRED = [CLUB, "carry_distance", "carry_deviation_distance", "launch_direction"]


def start_curve_finish(df: DataFrame) -> DataFrame:
    """Keep complete rows, then start = carry * tan(launch direction),
    finish = (carry deviation distance, carry), curve = finish_x - start."""
    require_columns(df, ["carry_distance", "carry_deviation_distance", "launch_direction"], "start_curve_finish")
    present = [c for c in DECOMPOSE_REQUIRED if c in df.columns]
    out = df.na.drop(subset=present) if present else df
    start = F.col("carry_distance") * F.tan(F.radians("launch_direction"))
    return (out.withColumn("start_yards", start)
               .withColumn("finish_x", F.col("carry_deviation_distance"))
               .withColumn("finish_y", F.col("carry_distance"))
               .withColumn("curve_yards", F.col("finish_x") - F.col("start_yards")))


def shape_labels(df: DataFrame, start_tol: float = START_TOL, curve_tol: float = CURVE_TOL) -> DataFrame:
    return df.withColumn("shape", shape_label("start_yards", "curve_yards", start_tol, curve_tol))


def shape_summary(df: DataFrame, by: Sequence[str] = (), decimals: int = 2,
                  sort: bool = False) -> DataFrame:
    """Per club: shots, most common shape (ties -> alphabetically first, NULL
    shapes skipped), mean start / curve / finish and sample std of finish,
    numerics rounded to ``decimals``.

    The labels made here are few and known, so each has a conditional count in
    the one hash aggregate, and the most common one is the least (-count,
    label).  A caller's own ``shape`` column may hold any label and goes
    through ``mode``, whose label->count map per group holds as many entries as
    there are labels.  ``sort=True`` adds the display order (shots desc, club
    asc), a range-partitioned sort.
    """
    own = "shape" in df.columns
    df = df if own else shape_labels(df)
    counts = ([F.mode("shape", True).alias("most_common_shape")] if own else
              [F.count(F.when(F.col("shape") == label, 1)).alias(f"_n{k}") for k, label in enumerate(SHAPES)])
    out = df.groupBy(*by, CLUB).agg(
        F.count(F.lit(1)).alias("shots"),
        *counts,
        np_round(F.avg("start_yards"), decimals).alias("avg_start_yards"),
        np_round(F.avg("curve_yards"), decimals).alias("avg_curve_yards"),
        np_round(F.avg("finish_x"), decimals).alias("avg_finish_yards"),
        np_round(F.stddev_samp("finish_x"), decimals).alias("finish_std_yards"),
    )
    if not own:
        # Labels that do not occur drop out as NULL, which ``least`` skips.
        most = F.least(*[F.when(F.col(f"_n{k}") > 0, F.struct(-F.col(f"_n{k}"), F.lit(label).alias("label")))
                         for k, label in enumerate(SHAPES)])
        out = out.select(*by, CLUB, "shots", most["label"].alias("most_common_shape"),
                         "avg_start_yards", "avg_curve_yards", "avg_finish_yards", "finish_std_yards")
    if sort:
        out = out.orderBy(*by, F.desc("shots"), F.asc_nulls_last(CLUB))
    return out


def shape_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shots per (club, shape) label."""
    if "shape" not in df.columns:
        df = shape_labels(df)
    return df.groupBy(*by, CLUB, "shape").agg(F.count(F.lit(1)).alias("shots"))


def mode_of(df: DataFrame, col: str, by: Sequence[str] = (), counted: bool = False) -> DataFrame:
    """A5: most common non-NULL value per group, smallest on ties; NULL when
    a group has no value.  ``counted=True`` counts per (group, value) first, for
    groups with more distinct values than a map of one task should hold."""
    if counted:
        v = F.col(col)
        counts = df.groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        first = F.when(F.col("_v").isNotNull(), F.struct(-F.col("_n"), F.col("_v").alias("v")))
        return counts.groupBy(*by).agg(F.min(first)["v"].alias(f"mode_{col}"))
    return df.groupBy(*by).agg(F.mode(col, True).alias(f"mode_{col}"))
