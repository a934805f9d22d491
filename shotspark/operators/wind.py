"""Wind-adjusted carry tables, four variants kept apart on purpose.

W1 (API): base = round(mean, 1); each band = round(base * (1 + factor), 1),
           i.e. it rounds the already-rounded base.
W2 (script): each band = round(mean * multiplier, 1) from the unrounded mean.
W3 (script): headwind penalty in yards = mean * fraction.
W4 (script): tailwind carry = mean - 5/2.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.functions.expr import np_round
from shotspark.schema import (BASE_CARRY, SCRIPT_HEADWIND_PENALTY, SCRIPT_TAILWIND_SUBTRACT,
                              SCRIPT_WIND_MULTIPLIERS, WIND_FACTORS)

CLUB = "club_type"
WIND_COLUMNS = [BASE_CARRY] + [name for name, _ in WIND_FACTORS]


def _mean_carry(df: DataFrame, by: Sequence[str], drop_null_club: bool) -> DataFrame:
    if drop_null_club:
        df = df.where(F.col(CLUB).isNotNull())
    return df.groupBy(*by, CLUB).agg(F.avg("carry_distance").alias("_mean"))


def avg_carry_wind(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Base carry and eight wind bands per club (NULL club kept)."""
    m = _mean_carry(df, by, drop_null_club=False)
    base = np_round("_mean", 1)
    m = m.select(*by, CLUB, base.alias(BASE_CARRY))
    return m.select(*by, CLUB, F.col(f"`{BASE_CARRY}`"),
                    *[np_round(F.col(f"`{BASE_CARRY}`") * F.lit(1 + f), 1).alias(name)
                      for name, f in WIND_FACTORS])


def script_wind_pct(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Base and bands from the unrounded mean (NULL club dropped)."""
    m = _mean_carry(df, by, drop_null_club=True)
    return m.select(*by, CLUB, np_round("_mean", 1).alias(BASE_CARRY),
                    *[np_round(F.col("_mean") * F.lit(k), 1).alias(name)
                      for name, k in SCRIPT_WIND_MULTIPLIERS])


def script_headwind_yards(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Yards lost into a headwind, per band (mean carry * fraction)."""
    m = _mean_carry(df, by, drop_null_club=True)
    return m.select(*by, CLUB, *[(F.col("_mean") * F.lit(k)).alias(name)
                                 for name, k in SCRIPT_HEADWIND_PENALTY])


def script_tailwind_yards(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """0-5 mph tailwind carry = mean - 5/2."""
    m = _mean_carry(df, by, drop_null_club=True)
    return m.select(*by, CLUB, (F.col("_mean") - F.lit(SCRIPT_TAILWIND_SUBTRACT)).alias("0 to 5mph"))
