"""The notebook script's per-club analyses: means, ideal iron gap, yardage
gaps between neighbouring clubs and the bag-ordered wind table.

Clubs are matched by code after normalising long names (``7 Iron`` -> ``7i``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.functions.expr import np_round
from shotspark.operators.clubs import CLUB_CODES, bag_position, club_code
from shotspark.schema import GAP_EDGES, IDEAL_GAP_CLUB, IDEAL_GAP_DIVISOR, SCRIPT_MEAN_COLUMNS

CLUB = "club_type"


def club_means(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-club means of carry, ball speed, spin rate, apex and club
    speed (NULL club dropped), plus the carry mean rounded to 2."""
    m = (df.where(F.col(CLUB).isNotNull()).groupBy(*by, CLUB)
           .agg(*[F.avg(c).alias(c) for c in SCRIPT_MEAN_COLUMNS]))
    return m.withColumn("avg_carry_yds", np_round("carry_distance", 2))


def ideal_gap(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean 7-iron club speed / 10, rounded to 2 (groups with no 7-iron
    shot get NULL)."""
    is7 = club_code(CLUB) == IDEAL_GAP_CLUB
    # mean(speed) / 10 == mean(speed / 10), but sums the raw speeds, so the
    # result does not depend on summation order when speeds are exact.
    mean7 = F.avg(F.when(is7, F.col("club_speed")))
    return df.groupBy(*by).agg(np_round(mean7 / F.lit(float(IDEAL_GAP_DIVISOR)), 2).alias("ideal_gap_yds"))


def yardage_gaps(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Carry gap for each of the 14 (shorter, longer) club edges:
    mean(longer) - mean(shorter); NULL when either club is absent.

    One aggregate pivots the mean carry of the 14 clubs into columns (no
    join, no cross product), then one projection stacks the 14 edges.
    """
    code = club_code(CLUB)
    wide = (df.where(code.isin(CLUB_CODES))
              .withColumn("_code", code)
              .groupBy(*by).pivot("_code", CLUB_CODES).agg(F.avg("carry_distance")))
    edges = F.array(*[F.struct(F.lit(label).alias("gap"), F.lit(short).alias("shorter"),
                               F.lit(long).alias("longer"),
                               (F.col(f"`{long}`") - F.col(f"`{short}`")).alias("gap_yds"))
                      for label, short, long in GAP_EDGES])
    out = wide.select(*by, F.inline(edges))
    return out.withColumn("gap_yds_display", np_round("gap_yds", 0))


def bag_order(wide: DataFrame, by: Sequence[str] = (), display_decimals: int | None = 0) -> DataFrame:
    """A per-club table in bag order (Driver first), with the bag
    position as a column; unknown clubs get NULL position and sort last.
    Numeric columns rounded to ``display_decimals`` (None keeps them)."""
    out = wide.withColumn("pos", bag_position(CLUB).cast("bigint"))
    if display_decimals is not None:
        keep = set(by) | {CLUB, "pos"}
        out = out.select(*[np_round(F.col(f"`{c}`"), display_decimals).alias(c)
                           if c not in keep and t in ("double", "float", "bigint", "int") else F.col(f"`{c}`")
                           for c, t in out.dtypes])
    return out


def sort_bag(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*by, F.asc_nulls_last("pos"), F.asc_nulls_last(CLUB))
