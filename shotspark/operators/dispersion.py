"""Dispersion statistics and the data behind the dispersion charts.

Corridor and mean are quantile/mean aggregates; the covariance ellipse is
the closed-form eigen-decomposition of the 2x2 sample covariance, all as
built-in aggregates and column math (no per-group Python).
"""

from __future__ import annotations

import math
from typing import NamedTuple, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.functions.expr import is_finite, nan_to_null, to_double
from shotspark.operators.deliverables import require_columns
from shotspark.operators.ordering import with_percentiles
from shotspark.schema import CORRIDOR_LEVEL, ELLIPSE_MIN_POINTS, ELLIPSE_POINTS, ELLIPSE_SIGMA

CLUB = "club_type"


def corridor_bounds(level: float = CORRIDOR_LEVEL) -> tuple[float, float]:
    lo = (1 - level) / 2
    return lo, 1 - lo


def corridor(df: DataFrame, col: str = "finish_x", level: float = CORRIDOR_LEVEL,
             by: Sequence[str] = (), ranked: bool = False) -> DataFrame:
    """Central ``level`` quantile band of ``col`` (linear interpolation) and
    the mean line; NULL triple when a group has no value.

    Exact ``percentile`` keeps a value->count map per group, so a hot group
    ships its distinct values, not its rows; ``ranked=True`` gives the same
    values without a map (``ordering.percentiles``), for groups of any size.
    """
    require_columns(df, [*by, col], "corridor")
    lo, hi = corridor_bounds(level)
    x = to_double(F.col(col)) if dict(df.dtypes)[col] == "string" else nan_to_null(F.col(col).cast("double"))
    if ranked:
        values = df.select(*by, x.alias("_x"))
        out = with_percentiles(values.groupBy(*by).agg(F.avg("_x").alias("mean_x")), values, "_x", [lo, hi], by)
        out = out.withColumnRenamed("_ps", "_q")
    else:
        out = df.groupBy(*by).agg(F.percentile(x, [lo, hi]).alias("_q"), F.avg(x).alias("mean_x"))
    return out.select(*by, F.col("_q")[0].alias("corridor_lower"),
                      F.col("_q")[1].alias("corridor_upper"),
                      (F.col("_q")[1] - F.col("_q")[0]).alias("corridor_width"),
                      "mean_x")


def mean_of(df: DataFrame, col: str, by: Sequence[str] = (), alias: str | None = None) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col).alias(alias or f"mean_{col}"))


def ellipse(df: DataFrame, x: str = "finish_x", y: str = "finish_y",
            n_sigma: float = ELLIPSE_SIGMA, by: Sequence[str] = (),
            min_points: int = ELLIPSE_MIN_POINTS) -> DataFrame:
    """``n_sigma`` covariance ellipse over rows where both coordinates are finite.

    a = var(x), c = var(y), b = cov(x, y);  eigenvalues m +- d with
    m = (a + c) / 2, d = sqrt(((a - c) / 2)^2 + b^2);  full axes
    2 * n_sigma * sqrt(max(lambda, 0));  major-axis angle 0.5 * atan2(2b, a - c).
    Groups with fewer than ``min_points`` finite rows produce no row.
    """
    require_columns(df, [*by, x, y], "ellipse")
    pts = df.where(is_finite(x) & is_finite(y))
    s = pts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.covar_samp(x, y).alias("cov_xy"),
    ).where(F.col("_n") >= min_points)
    s = s.select(*by, F.col("_n").alias("n"), "mean_x", "mean_y", "var_x", "var_y", "cov_xy")
    a, b, c = F.col("var_x"), F.col("cov_xy"), F.col("var_y")
    m = (a + c) / 2
    d = F.sqrt(F.pow((a - c) / 2, 2) + F.pow(b, 2))
    k = 2 * n_sigma
    return s.select(
        "*",
        (F.lit(k) * F.sqrt(F.greatest(m + d, F.lit(0.0)))).alias("width"),
        (F.lit(k) * F.sqrt(F.greatest(m - d, F.lit(0.0)))).alias("height"),
        (F.lit(0.5) * F.atan2(2 * b, a - c)).alias("theta"),
    )


def ellipse_path(ell: DataFrame, by: Sequence[str] = (), n: int = ELLIPSE_POINTS) -> DataFrame:
    """``n`` outline points per ellipse, t = linspace(0, 2*pi, n), ordered by t.

    A generator (``explode``) on each ellipse row: no shuffle.
    """
    step = 2 * math.pi / (n - 1)
    i = F.col("i")
    t = F.when(i == n - 1, F.lit(2 * math.pi)).otherwise(i.cast("double") * F.lit(step))
    pts = ell.select(*by, "mean_x", "mean_y", "width", "height", "theta",
                     F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    pts = pts.withColumn("t", t)
    ct, st = F.cos("t"), F.sin("t")
    cth, sth = F.cos("theta"), F.sin("theta")
    hw, hh = F.col("width") / 2, F.col("height") / 2
    return pts.select(
        *by, F.col("i").cast("bigint").alias("i"),
        (F.col("mean_x") + hw * ct * cth - hh * st * sth).alias("x"),
        (F.col("mean_y") + hw * ct * sth + hh * st * cth).alias("y"),
        "t",
    )


def dispersion_points(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scatter points of the finish dispersion chart."""
    require_columns(df, [*by, CLUB, "finish_x", "finish_y"], "dispersion_points")
    return df.select(*by, CLUB, "finish_x", "finish_y")


def binned_points(df: DataFrame, x: str = "finish_x", y: str = "finish_y", cell: float = 5.0,
                  by: Sequence[str] = ()) -> DataFrame:
    """R4 for a user of any size: the scatter on a grid of ``cell`` yards.

    Per occupied cell: its number of points, its centre, and one of its points
    (``shown_x``, ``shown_y``; the one with the smallest hash, so reruns agree).
    Points without two finite coordinates share one row with NULL cell, so the
    counts add up to the rows of ``dispersion_points``.  One partial aggregate:
    a hot group sends its occupied cells, never its points.
    """
    require_columns(df, [*by, x, y], "binned_points")
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    whole = is_finite(x) & is_finite(y)
    cells = df.select(*by, *[F.when(whole, F.floor(c / F.lit(float(cell))).cast("long")).alias(n)
                             for n, c in (("cell_x", px), ("cell_y", py))],
                      F.when(whole, F.struct(F.xxhash64(px, py), px.alias("x"), py.alias("y"))).alias("_pt"))
    out = cells.groupBy(*by, "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("shots"), F.min("_pt").alias("_pt"))
    middle = [((F.col(n) + F.lit(0.5)) * F.lit(float(cell))).alias(m) for n, m in (("cell_x", "mid_x"), ("cell_y", "mid_y"))]
    return out.select(*by, "cell_x", "cell_y", "shots", *middle,
                      F.col("_pt.x").alias("shown_x"), F.col("_pt.y").alias("shown_y"))


def start_vs_curve_points(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scatter points of the start-vs-curve chart."""
    require_columns(df, [*by, CLUB, "start_yards", "curve_yards"], "start_vs_curve_points")
    return df.select(*by, CLUB, "start_yards", "curve_yards")


def club_dispersion(df: DataFrame, club: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One club's (or every non-NULL club's) raw points with its mean-carry line.

    The mean is a partial aggregate per (by, club) joined back on the group
    keys; a hot group is split by AQE's skew-join handling instead of being
    gathered into one window task.
    """
    require_columns(df, [*by, CLUB, "carry_deviation_distance", "carry_distance"], "club_dispersion")
    pts = df.where(F.col(CLUB).isNotNull() if club is None else F.col(CLUB) == club)
    pts = pts.select(*by, CLUB, "carry_deviation_distance", "carry_distance")
    means = pts.groupBy(*by, CLUB).agg(F.avg("carry_distance").alias("mean_carry"))
    return pts.join(means, [*by, CLUB], "inner")


class FinishDispersion(NamedTuple):
    points: DataFrame
    corridor: DataFrame
    ellipse: DataFrame
    ellipse_path: DataFrame


def finish_dispersion(sc: DataFrame, by: Sequence[str] = (), level: float = CORRIDOR_LEVEL,
                      n_sigma: float = ELLIPSE_SIGMA) -> FinishDispersion:
    """The four layers of the finish-dispersion chart (points, 95 %
    corridor with mean line, 2-sigma ellipse and its outline)."""
    ell = ellipse(sc, by=by, n_sigma=n_sigma)
    return FinishDispersion(dispersion_points(sc, by), corridor(sc, "finish_x", level, by), ell,
                            ellipse_path(ell, by))
