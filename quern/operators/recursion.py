"""Recursive UNION DISTINCT, which Spark's SQL lacks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """All rows that step reaches from seed, each once.

    A round works on the rows that the last one added. Each round's rows are
    written once, as Parquet in the shared checkpoint folder, and merged by
    doubling, so that a row is written again only a logarithmic number of times:
    plans stay short and lost executors are no loss.
    """
    delta = _kept(seed.distinct())
    parts = [(1, delta)]  # (rounds held, rows)
    for _ in range(most):
        known = reduce(DataFrame.unionByName, (rows for _, rows in parts))
        delta = _kept(step(delta).distinct().subtract(known))
        if delta.isEmpty():
            return known
        parts.append((1, delta))
        while len(parts) > 1 and parts[-2][0] == parts[-1][0]:
            (n, newer), (m, older) = parts.pop(), parts.pop()
            parts.append((n + m, _kept(older.unionByName(newer))))
    raise RuntimeError(f"3636: no fixpoint after {most} rounds")


def _kept(rows: DataFrame) -> DataFrame:
    """rows, written and read again: lineage ends, and nothing of their plan, such as its constraints, stays."""
    spark = rows.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/fixpoint-{uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
