"""ENUM and SET columns: text with a declared order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def enum_index(x: Column, labels: list[str]) -> Column:
    """Position of the label from 1; 0 for another text, NULL for NULL: what ORDER BY and GROUP BY use."""
    return F.array_position(F.array(*[F.lit(v) for v in labels]), x)


def set_mask(x: Column, members: list[str]) -> Column:
    """The bit mask of a comma list: what ORDER BY uses."""
    bits = [F.when(F.find_in_set(F.lit(m), x) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(members)]
    out = bits[0].cast("bigint")
    for b in bits[1:]:
        out = out + b
    return out
