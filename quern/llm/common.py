"""What the operators share: the shared work folder, written tables, components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.session import shared_dir

#: Shuffle files of a statement are removed when it ends, not when the JVM collects garbage.
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: list[str] = []


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage and survives the loss of any executor. The shuffle
    files of the job go when it ends, and so does memory that the driver's JVM
    has freed outside its heap. The tables of an application lie in one folder;
    drop() removes one of them, drop_work_tables() all, and so does the end of
    the Python process.
    """
    path = f"{_work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_SHUFFLES)
        else:
            spark.conf.set(_CLEAN_SHUFFLES, before)
    trim(spark)
    return _table(spark, df.schema, [path])


def together(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    """Tables of materialize() that have one schema, as a single table."""
    return _table(spark, tables[0].schema, [p for t in tables for p in t.work_paths])


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables of materialize() that nothing will read again."""
    for t in tables:
        for p in t.work_paths:
            _delete(spark, p)


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM give back to the system what it has freed outside the heap; False where it can't.

    The allocator keeps freed memory for each thread, some hundred MB over the
    many plans of an operator. No object is collected, and nothing that is in
    use changes.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # a JVM or a system without it
        return False
    return True


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Writes what make() gives, then removes the work tables that it was made of."""
    first = len(_MADE)
    out = materialize(spark, make(), name)
    for path in _MADE[first:]:
        if path not in out.work_paths:
            _delete(spark, path)
    del _MADE[first:]
    return out


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text, t1 and t2."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def quoted(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """The stems, each lengthened until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        while s.lower() in taken:
            s += "_"
        taken.add(s.lower())
        out.append(s)
    return out


def _table(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    out = spark.read.schema(schema).parquet(*paths)
    out.work_paths = paths
    _MADE.extend(p for p in paths if p not in _MADE)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_work_tables(spark: SparkSession) -> None:
    """Removes what materialize() has written for this application."""
    _delete(spark, _work_dir(spark))
    _MADE.clear()


def _work_dir(spark: SparkSession) -> str:
    at = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}"
    if at not in _REGISTERED:
        _REGISTERED.add(at)
        atexit.register(_drop_at_exit)
    return at


_REGISTERED: set[str] = set()


def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        drop_work_tables(spark)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges(a, b); component is its smallest id.

    Alternates large-star and small-star steps; both are a map-side reducible
    minimum per vertex and a plain join, which Spark splits where a vertex is
    hot. Every round is written to the shared folder; the driver sees only
    counts. Null ids and loops are left out.
    """
    cur = (
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .filter("v is not null and m is not null and v <> m")
        .distinct()
    )
    cur = materialize(spark, cur, "cc")
    while not _is_stars(cur):
        before, cur = cur, materialize(spark, _small_star(_large_star(cur)), "cc")
        drop(spark, before)
    children = cur.select(F.col("v").alias("id"), F.col("m").alias("component"))
    roots = cur.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()
    return children.unionByName(roots)


def _is_stars(cur: DataFrame) -> bool:
    """True if every vertex has one parent, and no parent has a parent."""
    ends = cur.select(F.col("v").alias("id"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(
        cur.select(F.col("m").alias("id"), F.lit(0).alias("ups"), F.lit(1).alias("downs"))
    )
    both = ends.groupBy("id").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return both.filter("ups > 1 or ups = 1 and downs = 1").isEmpty()


def _large_star(cur: DataFrame) -> DataFrame:
    down = cur.select(F.col("m").alias("u"), F.col("v").alias("w"))  # all of them greater, as v > m
    both = cur.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(down)
    least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
    return down.join(least, "u").select(F.col("w").alias("v"), "m").distinct()


def _small_star(cur: DataFrame) -> DataFrame:
    least = cur.groupBy("v").agg(F.min("m").alias("least"))
    moved = cur.join(least, "v").filter("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))
    return moved.unionByName(least.select("v", F.col("least").alias("m"))).distinct()
