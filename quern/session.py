"""Sessions with the settings that MySQL semantics need."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "false",  # division by zero and bad casts give NULL
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small shuffle partitions, merged up to 16 MB: a task's memory then depends less on the input
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def engine_session(spark: SparkSession) -> SparkSession:
    """A session beside spark: same context, own views and settings."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions",):
        own.conf.set(key, spark.conf.get(key))
    for key, value in SETTINGS.items():
        own.conf.set(key, value)
    return own


_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session names none is one chosen here: a temporary folder
    if the master is local (as in tests), else a folder in the warehouse.
    """
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if sc.applicationId not in _DIRS:
        if sc.master == "local" or sc.master.startswith("local["):
            _DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quern-")
        else:
            _DIRS[sc.applicationId] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quern_work"
    return _DIRS[sc.applicationId]
