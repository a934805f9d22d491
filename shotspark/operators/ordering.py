"""Order that a distributed result can carry: positions, running sums, exact order
statistics.

A group may hold any share of the rows, so no window gathers a group.  Rows are dealt
by range of (group, order), numbered inside their partitions, and a table of one row
per partition and group that meet gives each partition its offset.  The dealt rows
are written, so that a lost executor cannot deal them anew.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.session import checkpoint_dir, shuffles_end_with_jobs

_NOT_IN_PARQUET = (T.NullType, T.CalendarIntervalType)


def same(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """All pairs equal, NULL being equal to NULL."""
    return reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in pairs], F.lit(True))


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder, a third of a checkpoint's
    bytes; its rows may lie in other partitions then."""
    spark, names = df.sparkSession, df.columns
    folder = checkpoint_dir(spark).rstrip("/")
    with shuffles_end_with_jobs(spark):
        if any(isinstance(f.dataType, _NOT_IN_PARQUET) for f in df.schema):
            return df.checkpoint(eager=True)
        df = df.toDF(*[f"c{k}" for k in range(len(names))])
        df.write.option("compression", "zstd").parquet(path := f"{folder}/shotspark-dealt-{uuid.uuid4().hex[:12]}")
    return spark.read.schema(df.schema).parquet(path).toDF(*names)


def running(df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``df`` with ``_before``, the sum of ``weight`` (1 without) over the rows of the
    same group that come earlier by ``order``, and ``_total``, the group's sum.

    Rows that ``order`` does not tell apart come in any order among themselves."""
    by = [*[F.col(f"`{w}`").asc_nulls_first() for w in within], *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = _written(dealt).withColumn("_part", F.shiftright("_at", 33))
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    spans = dealt.groupBy("_part", *within).agg(F.min("_at").alias("_first"), F.sum(amount).alias("_sum"))
    group = Window.partitionBy(*within)
    # As many rows as partitions plus groups; each group's are ordered by partition.
    spans = spans.select(F.col("_part").alias("_p"), "_first", *[F.col(f"`{w}`").alias(f"_w{k}") for k, w in enumerate(within)],
                         F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                                    F.lit(0)).alias("_base"), F.sum("_sum").over(group).alias("_total"))
    if weight is None:
        dealt = dealt.withColumn("_own", F.col("_at"))
    else:
        # A chunk is the part of a group that lies in one partition.
        chunk = Window.partitionBy("_part", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumn("_own", F.coalesce(F.sum(weight).over(chunk), F.lit(0)))
    on = (F.col("_part") == F.col("_p")) & same([(F.col(f"`{w}`"), F.col(f"_w{k}")) for k, w in enumerate(within)])
    start = F.col("_first") if weight is None else F.lit(0)
    # Without groups a row per partition, which is sent to the rows; they are not shuffled again.
    out = dealt.join(spans if within else F.broadcast(spans), on).withColumn("_before", F.col("_base") + F.col("_own") - start)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "_before", "_total")


def positions(df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "position",
              start: int = 0) -> DataFrame:
    """``df`` with a contiguous row number by ``order``, from ``start``, in each group."""
    out = running(df, order, within)
    return out.withColumn(name, F.col("_before") + F.lit(start)).drop("_before", "_total")


def percentiles(df: DataFrame, col: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles (linear interpolation, NULLs skipped) as the array ``_ps``, for
    groups of any size: values are counted map-side, the distinct ones get their
    ranks by running sums, and the two ranks next to each percentile are picked by
    a partial aggregate.  A group without a value has no row."""
    x = F.col(f"`{col}`").cast("double")
    counts = df.where(x.isNotNull()).groupBy(*by, x.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(counts, [F.col("_v")], by, weight="_n")
    picked, total = [], F.col("_total")
    for k, p in enumerate(at):
        place = F.lit(float(p)) * (total - 1)
        for side, rank in (("l", F.floor(place)), ("h", F.ceil(place))):
            held = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
            picked.append(F.max(F.when(held, F.col("_v"))).alias(f"_{side}{k}"))
    out = ranks.groupBy(*by).agg(F.max("_total").alias("_total"), *picked)
    values = []
    for k, p in enumerate(at):
        place = F.lit(float(p)) * (total - 1)
        low, high = F.col(f"_l{k}"), F.col(f"_h{k}")
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        values.append(F.when(low == high, low).otherwise(between))
    out = out.where("_total IS NOT NULL") if not by else out
    return out.select(*[F.col(f"`{b}`") for b in by], F.array(*values).alias("_ps"))


def with_percentiles(base: DataFrame, df: DataFrame, col: str, at: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``base`` (a row per group of ``df``) with ``_ps``, NULL for a group without a value."""
    ps = percentiles(df, col, at, by)
    ps = ps.select(F.col("_ps"), *[F.col(f"`{b}`").alias(f"_b{k}") for k, b in enumerate(by)])
    on = same([(base[b], F.col(f"_b{k}")) for k, b in enumerate(by)])
    return base.join(ps, on, "left").drop(*[f"_b{k}" for k in range(len(by))])
