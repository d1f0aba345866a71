"""Change streams into versioned tables, with Structured Streaming.

An envelope is (table, op, txn, ordinal, version, before, after): op is c, u or
d; before and after are JSON text of a row. A micro-batch is applied as a
whole: what of a transaction is in it becomes visible together, by one append.
Rows that can't be decoded go to a side table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.sources.versioned import DELETED, VERSION, latest

#: The column that a batch's folder stands for.
BATCH = "quern_batch"
ENVELOPE = T.StructType([T.StructField(name, T.LongType() if name in ("ordinal", "version") else T.StringType()) for name in ("table", "op", "txn", "ordinal", "version", "before", "after")])


def mutations(envelopes: DataFrame, schema: T.StructType, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(change rows, rows that can't be decoded) of one table's envelopes.

    An insert or update gives the row after it; a delete, and an update that
    changes the key, a tombstone for the row before it. Without a key, updates
    and deletes can't be applied and are quarantined.
    """
    need_before, need_after = F.col("op").isin("u", "d"), F.col("op").isin("c", "u")
    strict = {"mode": "PERMISSIVE"}
    parsed = envelopes.withColumns({"_b": F.from_json("before", schema, strict), "_a": F.from_json("after", schema, strict)})
    keyed = lambda r: F.lit(True) if not key else sum_all([F.col(f"{r}.{c}").isNotNull() for c in key])
    good = F.col("op").isin("c", "u", "d") & (~need_after | F.col("_a").isNotNull() & keyed("_a")) & (~need_before | F.col("_b").isNotNull() & keyed("_b"))
    if not key:
        good = (F.col("op") == "c") & F.try_parse_json("after").isNotNull()
    good = F.coalesce(good, F.lit(False)) & F.col("version").isNotNull()
    bad = parsed.filter(~good).select(*envelopes.columns)
    ok = parsed.filter(good)
    order = F.struct("version", F.coalesce("ordinal", F.lit(0)).alias("ordinal"))
    ups = ok.filter(need_after).select("_a.*", order.alias(VERSION), F.lit(False).alias(DELETED))
    moved = (F.col("op") == "d") | sum_any([~F.col(f"_b.{c}").eqNullSafe(F.col(f"_a.{c}")) for c in key]) if key else F.lit(False)
    downs = ok.filter(need_before & moved).select("_b.*", order.alias(VERSION), F.lit(True).alias(DELETED))
    return ups.unionByName(downs), bad


def sum_all(parts: list) -> F.Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def sum_any(parts: list) -> F.Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def apply_stream(
    spark: SparkSession, envelopes: DataFrame, table: str, schema: T.StructType, key: list[str], path: str, fence: int = -1, once: bool = True
) -> StreamingQuery:
    """Appends a table's changes to path/changes and undecodable rows to path/quarantine.

    Versions up to fence are in the snapshot and skipped. The checkpoint is in
    path/checkpoint; each batch has a folder of its own, which a batch that is
    run again overwrites, so that tables without a key don't repeat rows either.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows, bad = mutations(batch.filter((F.col("table") == table) & (F.coalesce("version", F.lit(fence + 1)) > fence)), schema, key)
        rows.write.mode("overwrite").parquet(f"{path}/changes/{BATCH}={number}")
        bad.write.mode("overwrite").parquet(f"{path}/quarantine/{BATCH}={number}")

    writer = envelopes.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="250 milliseconds")).start()


def read_table(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The table as it is now: all change rows if it has no key, else the newest of each key."""
    changes = spark.read.option("mergeSchema", "true").parquet(f"{path}/changes").drop(BATCH)
    return latest(changes, key) if key else changes.filter(~F.col(DELETED)).drop(VERSION, DELETED)
