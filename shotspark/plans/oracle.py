"""Helpers to write the DuckDB oracle SQL for the registered queries.

The oracle re-states each operator's semantics in plain SQL over the same
parquet views; it shares only the fixture view text with the Spark side.
"""

from __future__ import annotations

from shotspark.sources.testdata import SESSIONS_SQL, SHOTS_SQL

SHOTS_CTE = f"shots AS ({SHOTS_SQL})"
SESSIONS_CTE = f"sessions AS ({SESSIONS_SQL})"


def r6(expr: str) -> str:
    """Round a double to 6 decimals, half-to-even, -0.0 -> 0.0 (matches round_doubles)."""
    return f"(round_even(CAST(({expr}) AS DOUBLE) * 1e6, 0) / 1e6 + 0.0)"


def rnd(expr: str, decimals: int) -> str:
    """numpy-style round of the scaled value."""
    if decimals == 0:
        return f"(round_even(CAST(({expr}) AS DOUBLE), 0) + 0.0)"
    s = f"{10 ** decimals}.0"
    return f"(round_even(CAST(({expr}) AS DOUBLE) * {s}, 0) / {s} + 0.0)"


def dbl(x: float) -> str:
    """A double literal (DuckDB reads 0.95 as DECIMAL)."""
    return f"CAST({x!r} AS DOUBLE)"


def with_shots(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((SHOTS_CTE,) + ctes) + "\n" + body
