"""Column -> Column helpers.  All built-in expressions: they stay inside
whole-stage codegen, no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotspark.schema import BIAS_THRESHOLD, CURVE_TOL, NA_STRINGS, START_TOL

# Text accepted as a number (pandas to_numeric): optional sign and a decimal
# with optional exponent, blanks allowed around it; or inf/infinity in any
# case, with no blanks.  Rejects `12d`, `12f`, `1,234`, `0x1A`, `1_000`, `nan`
# and empty text, which a bare try_cast would partly accept.
NUMBER_RX = (r"^(\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)\s*"
             r"|[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?)$")



def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_small_methods(c) -> Column:
    """The same value, taken through a lambda, so that Spark compiles the projection
    it stands in as many small methods.

    Lambdas stay out of whole-stage code, and outside of it long projections are
    split.  Inside, a projection of twenty columns is one method of more than the
    8,000 bytes that the JVM compiles, and runs interpreted (measured: 27 us a row for
    the shots' formulas).  What is in the lambda is not compiled, so ``c`` is best a
    bare column; the fold over one literal takes its value as it is."""
    return F.aggregate(F.array(F.lit(0)), col(c), lambda value, _: value)


def np_round(c, decimals: int = 0) -> Column:
    """Half-to-even rounding of the scaled value (numpy/pandas ``round``).

    ``F.round`` is half-up and ``F.bround`` rounds the decimal text, both
    differ from numpy on values like 0.25 or 0.575.  ``+ 0.0`` maps -0.0 to 0.0.
    """
    x = col(c).cast("double")
    if decimals == 0:
        return F.rint(x) + F.lit(0.0)
    scale = float(10 ** decimals)
    return F.rint(x * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def nan_to_null(c) -> Column:
    """NaN -> NULL.  Spark aggregates propagate NaN, pandas skips it."""
    x = col(c)
    return F.nanvl(x, F.lit(None).cast("double"))


def null_if_na_text(c) -> Column:
    """CSV missing-value markers (pandas defaults) -> NULL, on string columns."""
    x = col(c)
    return F.when(~x.isin(NA_STRINGS), x)


def to_double(c) -> Column:
    """Numeric coercion with bad text -> NULL (never NaN, never an error)."""
    x = col(c)
    s = x.cast("string")
    return F.when(s.rlike(NUMBER_RX), s.try_cast("double"))


def is_finite(c) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def shape_label(start, curve, start_tol: float = START_TOL, curve_tol: float = CURVE_TOL) -> Column:
    """Nine-way shot shape from start offset and curve (inclusive tolerances)."""
    s, c = col(start), col(curve)
    missing = s.isNull() | c.isNull() | F.isnan(s) | F.isnan(c)
    start_dir = F.when(s < -start_tol, "Pull").when(s > start_tol, "Push")
    curve_dir = (F.when(c < -curve_tol, "Draw").when(c > curve_tol, "Fade")
                 .otherwise("Straight"))
    return (F.when(missing, "Unknown")
            .when(start_dir.isNull() & (curve_dir == "Straight"), "Straight")
            .otherwise(F.concat(F.coalesce(start_dir, F.lit("Center")), F.lit("-"), curve_dir)))


def bias_label(avg_face_to_path, threshold: float = BIAS_THRESHOLD) -> Column:
    """Face-bias label of a mean face-to-path; NULL/NaN fall to Neutral."""
    x = col(avg_face_to_path)
    ok = x.isNotNull() & ~F.isnan(x)
    return (F.when(ok & (x < -threshold), "Draw bias")
            .when(ok & (x > threshold), "Fade bias")
            .otherwise("Neutral"))


def round_doubles(df, decimals: int = 6):
    """Round every double column (used to compare floating results)."""
    from pyspark.sql import types as T
    return df.select([np_round(f.name, decimals).alias(f.name)
                      if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                      for f in df.schema.fields])
