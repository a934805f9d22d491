"""Long (chart-ready) forms of the wide tables."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotspark.functions.expr import to_double
from shotspark.schema import DEFAULT_PERFORMANCE_METRIC, PERFORMANCE_METRICS

CLUB = "club_type"


def wind_long(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(club, wind_condition, value) from a wind table; NULL values are kept.

    Every non-key column is a condition (``Base Carry`` included), values
    coerced to double.
    """
    ids = [*by, CLUB]
    values = [c for c in wide.columns if c not in ids]
    typed = wide.select(*ids, *[to_double(F.col(f"`{c}`")).alias(c) for c in values])
    return typed.unpivot(ids, [F.col(f"`{c}`") for c in values], "wind_condition", "value")


def performance_means(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the seven performance metrics per club; NULL club dropped."""
    return (df.where(F.col(CLUB).isNotNull())
              .groupBy(*by, CLUB)
              .agg(*[F.avg(src).alias(label) for src, label in PERFORMANCE_METRICS]))


def metric_long(means: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(club, metric, value) from the wide metric means."""
    ids = [*by, CLUB]
    cols = [c for c in means.columns if c not in ids]
    return means.unpivot(ids, [F.col(f"`{c}`") for c in cols], "metric", "value")


def rank_metrics(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bar order per metric: rank by value descending (NULL last).

    The window partitions by (by, metric): one partition holds at most one
    row per club, so its size is bounded by the club count, not the data.
    """
    w = Window.partitionBy(*by, "metric").orderBy(F.desc_nulls_last("value"))
    return long.withColumn("rank", F.rank().over(w))


def select_metric(long: DataFrame, metric: str = DEFAULT_PERFORMANCE_METRIC) -> DataFrame:
    return long.where(F.col("metric") == metric)


def performance_chart_data(df: DataFrame, by: Sequence[str] = (),
                           metric: str | None = DEFAULT_PERFORMANCE_METRIC) -> DataFrame:
    """Means -> long -> ranked; ``metric=None`` keeps all seven metrics."""
    ranked = rank_metrics(metric_long(performance_means(df, by), by), by)
    return ranked if metric is None else select_metric(ranked, metric)


# FIXED VALUES: y-axis domain of the carry comparison chart.
CARRY_DOMAIN_MAX = 320


def carry_comparison_data(wind_table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The long wind table behind the grouped carry bar chart."""
    return wind_long(wind_table, by)
