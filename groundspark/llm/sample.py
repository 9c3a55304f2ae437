"""Bounded samples for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_PARTS = 1_000_000


def bounded(df: DataFrame, most: int, *columns: str, keys: tuple[str, ...]) -> list[Row]:
    """At most ``most`` rows, chosen by a hash of the keys, so the same table gives the same rows however it is split.

    The share is set from a count first: about as many rows as are wanted come to the driver, not that many from each task.
    """
    n = df.count()
    share = _PARTS if n <= most else min(_PARTS, int(_PARTS * 1.1 * most / n) + 1)
    h = F.xxhash64(*keys)
    rows = df.filter(F.pmod(h, F.lit(_PARTS)) < share).select(h.alias("_h"), *columns).collect()
    return sorted(rows, key=lambda r: r[0])[:most]
