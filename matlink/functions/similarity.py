"""Token-set similarity of two texts, 0 to 1, as an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(x: str, y: str) -> int:
    """Length of the longest common subsequence, on the bits of an integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def token_set(x: str | None, y: str | None) -> float:
    """The best of three ratios between shared words alone and with either side's own words."""
    a, b = set((x or "").split()), set((y or "").split())
    if not a or not b:
        return 0.0
    both, own_a, own_b = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if both and not (own_a and own_b):
        return 1.0
    gap = 1 if both else 0
    la, lb = len(both) + gap + len(own_a), len(both) + gap + len(own_b)
    best = 1 - (len(own_a) + len(own_b) - 2 * _common(own_a, own_b)) / (la + lb)
    if both:
        best = max(best, 1 - (gap + len(own_a)) / (len(both) + la), 1 - (gap + len(own_b)) / (len(both) + lb))
    return best


def _similar(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([token_set(a, b) for a, b in zip(x, y, strict=True)], dtype=float)


def token_set_similarity(x, y) -> Column:
    """token_set() of two columns."""
    return F.pandas_udf(_similar, "double")(x, y)
