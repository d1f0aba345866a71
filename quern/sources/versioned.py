"""Versioned tables: change rows in Parquet, merged when read.

A change row has the table's columns, `_version` (the source's position, which
only grows: a number, or a struct of version and ordinal) and `_deleted`. The newest row of a key counts; a tombstone hides
it. Re-reading old changes adds rows that lose, so replays change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION, DELETED = "_version", "_deleted"


def latest(changes: DataFrame, key: list[str], keep_deleted: bool = False) -> DataFrame:
    """The newest row of each key, without deleted ones.

    max_by reduces before the shuffle, so a key with many versions costs one row
    a task. Equal versions are told apart by content, for the same answer every time.
    """
    rest = [c for c in changes.columns if c not in key]
    order = F.struct(F.col(VERSION), F.col(DELETED), F.xxhash64(*changes.columns))
    newest = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*").select(*changes.columns)
    return newest if keep_deleted else newest.filter(~F.col(DELETED)).drop(VERSION, DELETED)


def unique_visible(rows: DataFrame, unique: list[str]) -> DataFrame:
    """Of rows that collide on a secondary unique key the newest is visible; rows with a NULL in it all are."""
    free = rows.filter(" OR ".join(f"`{c}` IS NULL" for c in unique))
    bound = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in unique))
    kinds = dict(rows.dtypes)
    keys = [F.lower(c).alias(f"_u{i}") if kinds[c] == "string" else F.col(c).alias(f"_u{i}") for i, c in enumerate(unique)]
    best = bound.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(VERSION, F.xxhash64(*rows.columns))).alias("_row")).select("_row.*")
    return best.unionByName(free)


def checksums(rows: DataFrame, key: list[str], chunks: int) -> DataFrame:
    """(chunk, n, checksum): an order-free checksum of each chunk of keys."""
    chunk = F.pmod(F.xxhash64(*key), F.lit(chunks)).alias("chunk")
    content = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
    return rows.groupBy(chunk).agg(F.count("*").alias("n"), F.sum(content).alias("checksum"))


def poll_differences(source: DataFrame, replica: DataFrame, key: list[str], chunks: int = 64) -> DataFrame:
    """Keys to mend: (key..., action) with insert, update or delete.

    Chunks with equal checksums are skipped; rows of the others are compared by hash.
    """
    a, b = checksums(source, key, chunks), checksums(replica, key, chunks)
    dirty = a.alias("a").join(b.alias("b"), "chunk", "full_outer").filter(~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.checksum").eqNullSafe(F.col("b.checksum")))).select("chunk")

    def hashed(rows: DataFrame, name: str) -> DataFrame:
        out = rows.withColumn("chunk", F.pmod(F.xxhash64(*key), F.lit(chunks))).join(F.broadcast(dirty), "chunk", "left_semi")  # at most `chunks` rows
        return out.select(*key, F.xxhash64(*sorted(rows.columns)).alias(name))

    both = hashed(source, "_s").join(hashed(replica, "_r"), key, "full_outer")
    action = F.when(F.col("_r").isNull(), "insert").when(F.col("_s").isNull(), "delete").when(F.col("_s") != F.col("_r"), "update")
    return both.withColumn("action", action).filter("action IS NOT NULL").select(*key, "action")


def poll_cursor(source: DataFrame, cursor: str, since: object) -> DataFrame:
    """Rows at or after the cursor: the boundary is read again, as rows may share its value."""
    return source if since is None else source.filter(F.col(cursor) >= F.lit(since))


def _position(version: int | Column) -> Column:
    return version if isinstance(version, Column) else F.lit(version).cast("bigint")


def missing_keys(replica: DataFrame, source_keys: DataFrame, key: list[str], version: int | Column) -> DataFrame:
    """Tombstones for keys that the source no longer has."""
    gone = replica.join(source_keys, key, "left_anti")
    return gone.withColumns({VERSION: _position(version), DELETED: F.lit(True)})


def cascade_orphans(children: DataFrame, parents: DataFrame, foreign: str, parent_key: str, version: int | Column) -> DataFrame:
    """Tombstones for children whose parent is gone: cascades that the change log doesn't show."""
    orphans = children.filter(F.col(foreign).isNotNull()).join(parents.select(F.col(parent_key).alias(foreign)), foreign, "left_anti")
    return orphans.select(*children.columns).withColumns({VERSION: _position(version), DELETED: F.lit(True)})


def soft_deleted(rows: DataFrame, flag: Column) -> DataFrame:
    """Rows without those that a soft-delete column marks."""
    return rows.filter(~F.coalesce(flag, F.lit(False)))


def compact(changes: DataFrame, key: list[str], path: str) -> None:
    """Writes the newest row of each key, tombstones included: older segments may still be read beside it."""
    latest(changes, key, keep_deleted=True).write.mode("overwrite").parquet(path)
