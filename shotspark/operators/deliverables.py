"""Per-club deliverables (club summary, face variance, carry averages).

All three group by ``(*by, club_type)`` and keep the NULL club as its own
group.  ``deliverables`` computes the three in ONE aggregate (one shuffle on
the group keys, partial aggregation on the map side) and splits it by
projection.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.functions.expr import bias_label
from shotspark.operators.ordering import with_percentiles

CLUB = "club_type"

# FIXED VALUES: (output column, source metric, statistic) per deliverable.
CLUB_SUMMARY_SPEC = [
    ("avg_club_speed_mph", "club_speed", "mean"),
    ("avg_ball_speed_mph", "ball_speed", "mean"),
    ("avg_smash", "smash_factor", "mean"),
    ("avg_launch_deg", "launch_angle", "mean"),
    ("avg_launch_dir_deg", "launch_direction", "mean"),
    ("avg_carry_yd", "carry_distance", "mean"),
    ("std_carry_yd", "carry_distance", "std"),
    ("avg_total_yd", "total_distance", "mean"),
    ("std_total_yd", "total_distance", "std"),
    ("avg_backspin_rpm", "backspin", "mean"),
    ("avg_spin_axis_deg", "spin_axis", "mean"),
]
FACE_VARIANCE_SPEC = [
    ("avg_club_path_deg", "club_path", "mean"),
    ("avg_club_face_deg", "club_face", "mean"),
    ("avg_face_to_path_deg", "face_to_path", "mean"),
    ("std_face_to_path_deg", "face_to_path", "std"),
]
CARRY_SPEC = [
    ("avg_carry_yd", "carry_distance", "mean"),
    ("std_carry_yd", "carry_distance", "std"),
]
PERCENTILES = [("p10_carry_yd", 0.10), ("p50_carry_yd", 0.50), ("p90_carry_yd", 0.90)]


class Deliverables(NamedTuple):
    club_summary: DataFrame
    face_variance_by_club: DataFrame
    club_carry_averages: DataFrame


def require_columns(df: DataFrame, cols: Sequence[str], fn: str) -> None:
    """Plan-time schema check (no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{fn}: missing required columns: {missing}")


def _stat(src: str, stat: str) -> Column:
    return F.avg(src) if stat == "mean" else F.stddev_samp(src)


def _spec_aggs(df: DataFrame, spec) -> list[Column]:
    """Aggregates of a spec whose source column exists (missing -> dropped)."""
    return [_stat(src, stat).alias(out) for out, src, stat in spec if src in df.columns]


def with_face_to_path(df: DataFrame) -> DataFrame:
    """Derive face_to_path = club_face - club_path only when the column is absent."""
    if "face_to_path" not in df.columns and {"club_face", "club_path"} <= set(df.columns):
        return df.withColumn("face_to_path", F.col("club_face") - F.col("club_path"))
    return df


def _percentile_cols(df: DataFrame, exact: bool, accuracy: int) -> list[Column]:
    ps = [p for _, p in PERCENTILES]
    if exact:
        arr = F.percentile("carry_distance", ps)
    else:
        arr = F.percentile_approx("carry_distance", ps, accuracy)
    return [arr.alias("_carry_ps")]


def _split_percentiles(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.col("_carry_ps")[i].alias(name)
                            for i, (name, _) in enumerate(PERCENTILES)]).drop("_carry_ps")


def club_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    require_columns(df, [CLUB], "club_summary")
    return df.groupBy(*by, CLUB).agg(F.count(F.lit(1)).alias("shots"),
                                      *_spec_aggs(df, CLUB_SUMMARY_SPEC))


def face_variance(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    require_columns(df, [CLUB], "face_variance")
    df = with_face_to_path(df)
    out = df.groupBy(*by, CLUB).agg(F.count(F.lit(1)).alias("shots"),
                                     *_spec_aggs(df, FACE_VARIANCE_SPEC))
    if "avg_face_to_path_deg" in out.columns:
        out = out.withColumn("shape_bias", bias_label("avg_face_to_path_deg"))
    return out


def carry_averages(df: DataFrame, by: Sequence[str] = (), exact: bool = True,
                   accuracy: int = 10000, ranked: bool = False) -> DataFrame:
    """Shots, mean, sample std and p10/p50/p90 (linear interpolation) of carry.

    ``exact=True`` uses Spark's exact ``percentile``: its partial aggregate is
    a value->count map per group, so a hot group ships distinct carries, not
    rows.  ``exact=False`` switches to ``percentile_approx`` (bounded sketch)
    for metrics whose distinct values per group are unbounded; ``ranked=True``
    gives the same exact values without a map (``ordering.percentiles``), for
    groups with more distinct values than a task should hold.
    """
    require_columns(df, [CLUB, "carry_distance"], "carry_averages")
    if ranked:
        base = df.groupBy(*by, CLUB).agg(F.count(F.lit(1)).alias("shots"), *_spec_aggs(df, CARRY_SPEC))
        return _split_percentiles(with_percentiles(base, df, "carry_distance", [p for _, p in PERCENTILES], [*by, CLUB])
                                  .withColumnRenamed("_ps", "_carry_ps"))
    out = df.groupBy(*by, CLUB).agg(F.count(F.lit(1)).alias("shots"),
                                     *_spec_aggs(df, CARRY_SPEC),
                                     *_percentile_cols(df, exact, accuracy))
    return _split_percentiles(out)


def fused_deliverables(df: DataFrame, by: Sequence[str] = (), exact: bool = True,
                       accuracy: int = 10000) -> DataFrame:
    """All columns of the three deliverables from one aggregate."""
    require_columns(df, [CLUB], "deliverables")
    df = with_face_to_path(df)
    seen, aggs = set(), [F.count(F.lit(1)).alias("shots")]
    for spec in (CLUB_SUMMARY_SPEC, FACE_VARIANCE_SPEC):
        for out, src, stat in spec:
            if src in df.columns and out not in seen:
                seen.add(out)
                aggs.append(_stat(src, stat).alias(out))
    if "carry_distance" in df.columns:
        aggs += _percentile_cols(df, exact, accuracy)
    out = df.groupBy(*by, CLUB).agg(*aggs)
    if "_carry_ps" in out.columns:
        out = _split_percentiles(out)
    if "avg_face_to_path_deg" in out.columns:
        out = out.withColumn("shape_bias", bias_label("avg_face_to_path_deg"))
    return out


def _pick(fused: DataFrame, by: Sequence[str], names: list[str]) -> DataFrame:
    return fused.select(*by, CLUB, "shots", *[n for n in names if n in fused.columns])


def deliverables(df: DataFrame, by: Sequence[str] = (), exact: bool = True,
                 materialize: bool = False) -> Deliverables:
    """The three deliverables from one fused aggregate.

    With ``materialize=True`` the fused result is checkpointed (reliable
    checkpoint into the session's checkpoint folder) so that consuming the
    three frames runs the aggregate once.
    """
    fused = fused_deliverables(df, by, exact)
    if materialize:
        fused = fused.checkpoint(eager=True)
    return Deliverables(
        club_summary=_pick(fused, by, [o for o, _, _ in CLUB_SUMMARY_SPEC]),
        face_variance_by_club=_pick(fused, by, [o for o, _, _ in FACE_VARIANCE_SPEC] + ["shape_bias"]),
        club_carry_averages=_pick(fused, by, [o for o, _, _ in CARRY_SPEC] + [n for n, _ in PERCENTILES]),
    )


def drop_all_null(df: DataFrame, materialize: bool = False) -> DataFrame:
    """Drop columns that are NULL in every row (data-dependent schema, opt-in).

    One aggregate action over the frame (count of non-null per column).
    ``materialize=True`` checkpoints the frame first (reliable checkpoint in
    the session's checkpoint folder) so a large input is computed once, not
    once for the counts and again for the result.
    """
    if materialize:
        df = df.checkpoint(eager=True)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if counts[f"c{i}"] > 0]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def carry_extremes(df: DataFrame, by: Sequence[str] = (), value: str = "Base Carry",
                   club: str = CLUB, position: str | None = None) -> DataFrame:
    """Longest and shortest club by ``value``; NULL values skipped.

    Ties go to the first row: by ``position`` if given (file row order),
    else by club name ascending with the NULL club last (the order grouped
    results come out in).
    """
    require_columns(df, [value, club], "carry_extremes")
    v = F.col(f"`{value}`")
    c = F.col(club)
    tie = [F.col(position)] if position else [c.isNull(), c]
    longest_key = F.when(v.isNotNull(), F.struct(-v, *tie))
    shortest_key = F.when(v.isNotNull(), F.struct(v, *tie))
    return df.groupBy(*by).agg(
        F.max(v).alias("longest_value"),
        F.min_by(c, longest_key).alias("longest_club"),
        F.min(v).alias("shortest_value"),
        F.min_by(c, shortest_key).alias("shortest_club"),
    )
