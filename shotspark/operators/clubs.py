"""Club vocabulary: codes (D, 3W, 7i, ...) and long names (Driver, 3 Wood, ...).

Lookups are literal maps folded into the projection (no join): the
dimension is a fixed 14-row constant.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotspark.schema import CLUB_ALIASES, CLUBS


def _map(pairs) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs))


def club_code(c) -> Column:
    """Normalise a club name to its code; long names and aliases map to the
    code, unknown names pass through unchanged."""
    x = F.col(c) if isinstance(c, str) else c
    pairs = [(code, code) for _, code, _ in CLUBS] + [(name, code) for _, code, name in CLUBS]
    pairs += list(CLUB_ALIASES)
    return F.coalesce(F.element_at(_map(pairs), x), x)


def club_long_name(c) -> Column:
    x = club_code(c)
    return F.coalesce(F.element_at(_map([(code, name) for _, code, name in CLUBS]), x), x)


def bag_position(c) -> Column:
    """Position in the bag, long to short (Driver = 0); unknown -> NULL."""
    x = club_code(c)
    return F.element_at(_map([(code, pos) for pos, code, _ in CLUBS]), x)


CLUB_CODES = [code for _, code, _ in CLUBS]
