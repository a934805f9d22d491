"""Cleaning, coercion, renames and profiling."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.functions.expr import nan_to_null, np_round, to_double
from shotspark.schema import (METRICS, SCRIPT_DROPPED, SCRIPT_INT_COLUMNS, SNAKE_TO_TITLE,
                              TITLE_TO_SNAKE)

BOM = "\ufeff"


def clean_name(name: str) -> str:
    return str(name).strip().replace(BOM, "")


def snake(title: str) -> str:
    """Title Case raw header -> canonical snake_case column name."""
    t = clean_name(title)
    return TITLE_TO_SNAKE.get(t, t.lower().replace(" ", "_"))


def clean_headers(df: DataFrame) -> DataFrame:
    """strip blanks and BOM from every column name."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def coerce_numeric(df: DataFrame, cols: Sequence[str] = METRICS) -> DataFrame:
    """text -> double for the listed columns that are present; bad text
    -> NULL; NaN -> NULL on columns that are already double."""
    present = set(cols) & set(df.columns)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name not in present:
            out.append(c)
        elif isinstance(f.dataType, T.StringType):
            out.append(to_double(c).alias(f.name))
        else:
            out.append(nan_to_null(c.cast("double")).alias(f.name))
    return df.select(*out)


def normalize_avg_carry(df: DataFrame) -> DataFrame:
    """strip headers, coerce ``Base Carry``."""
    df = clean_headers(df)
    return coerce_numeric(df, ["Base Carry"]) if "Base Carry" in df.columns else df


def to_title_case(df: DataFrame) -> DataFrame:
    """snake_case shot columns -> Title Case (others unchanged)."""
    return df.withColumnsRenamed({s: t for s, t in SNAKE_TO_TITLE.items() if s in df.columns})


def to_snake_case(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({t: s for t, s in TITLE_TO_SNAKE.items() if t in df.columns})


def drop_columns(df: DataFrame, cols: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """drop named columns; ``strict`` raises when one is absent."""
    missing = [c for c in cols if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*[c for c in cols if c in df.columns])


def script_clean(df: DataFrame, strict: bool = False) -> DataFrame:
    """F4-F7, the notebook script's cleaning of a snake_case shot frame.

    Drop the unused raw columns; coerce the script's 23 columns (those
    present) to numbers, fill NULL with 0 and truncate toward zero to
    integers; round the remaining doubles to 2 decimals; drop rows with any
    NULL left (this removes the NULL-club rows, and rows missing the
    non-filled smash factor).
    """
    df = drop_columns(df, [snake(c) for c in SCRIPT_DROPPED], strict=strict)
    ints = {snake(c) for c in SCRIPT_INT_COLUMNS} & set(df.columns)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in ints:
            x = to_double(c) if isinstance(f.dataType, T.StringType) else nan_to_null(c.cast("double"))
            out.append(F.coalesce(x, F.lit(0.0)).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(np_round(c, 2).alias(f.name))
        else:
            out.append(c)
    out = df.select(*out)
    # "Drop rows with any NULL": the filled integer columns cannot be NULL
    # (coalesce with 0), so only the other columns are tested.  This keeps
    # column pruning intact: a query reading five columns does not evaluate
    # the other eighteen inside the filter.
    maybe_null = [c for c in out.columns if c not in ints]
    return out.na.drop("any", subset=maybe_null) if maybe_null else out


def clubs_distinct(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """distinct non-NULL clubs (sorted per ``by`` group when displayed)."""
    return df.select(*by, "club_type").where(F.col("club_type").isNotNull()).distinct()


def profile(df: DataFrame) -> DataFrame:
    """(column_name, non_null, dtype) per column from one aggregate pass."""
    names = [c for c, _ in df.dtypes]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)])
    slot_name = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(f"c{i}"), F.lit(c))])
    slot_type = F.create_map(*[x for i, (_, t) in enumerate(df.dtypes) for x in (F.lit(f"c{i}"), F.lit(t))])
    stack = counts.unpivot([], [f"c{i}" for i in range(len(names))], "slot", "non_null")
    return stack.select(F.element_at(slot_name, F.col("slot")).alias("column_name"),
                        "non_null", F.element_at(slot_type, F.col("slot")).alias("dtype"))


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows (a preview; the limit is the feature)."""
    return df.limit(n)


def for_club(df: DataFrame, club: str) -> DataFrame:
    """one club's rows, all columns."""
    return df.where(F.col("club_type") == club)


def sort_clubs(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Group keys ascending, NULL club last (the order grouped results come out in)."""
    return df.orderBy(*by, F.asc_nulls_last("club_type"))


def ensure_not_empty(df: DataFrame, message: str) -> DataFrame:
    """the empty-input guard, for the edge (one tiny action); library
    functions themselves return empty frames."""
    if df.isEmpty():
        raise LookupError(message)
    return df
