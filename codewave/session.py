"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "codewave", **overrides: str) -> SparkSession:
    """A session with adaptive execution and skew-join handling switched on."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**_SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may go without one; there a temporary folder is made and
    remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("codewave.local.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="codewave-")
        spark.conf.set("codewave.local.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/codewave-{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return path


@contextmanager
def clearing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind.

    Otherwise they stay until the driver's garbage collector finds them, so the files of many
    passes would lie on the disks together.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written.

    Used where one expensive result feeds several passes: lineage is cut, a lost
    executor costs a re-read only, and Spark knows the size of the table. No shuffle files are left.
    """
    path = scratch_path(df.sparkSession, name)
    with clearing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The same, bucketed by a key, so that grouping by it moves no row.

    The table is forgotten at once, its files go when the application ends.
    """
    spark, table = df.sparkSession, f"codewave_{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    with clearing_shuffles(spark):
        writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    staged = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return staged


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers of which ``repartition(n, key)`` and ``n`` buckets put each in a partition of its own.

    The numbers 0 to n - 1 as keys would leave a third of the partitions empty and put several
    numbers into one task. Partitions and buckets follow ``hash``, so it is asked here.
    """
    found: dict[int, int] = {}
    start, step = 0, n * (n.bit_length() + 8)
    while len(found) < n:
        key = F.col("id").cast("int")
        near = spark.range(start, start + step, numPartitions=1).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("p"))
        for row in near.agg(F.min(key).alias("key")).collect():
            found.setdefault(row["p"], row["key"])
        start += step
    return [found[p] for p in range(n)]


def block_of(ident: Column, n: int, spark: SparkSession) -> Column:
    """The block of a row by a hash of ``ident``: one of ``n`` keys that are dealt evenly."""
    return F.get(F.lit(even_keys(spark, n)), F.pmod(ident, F.lit(n)).cast("int")).cast("int")


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """A scan with fewer splits than cores, spread by ``key`` for costly work per row.

    A large table has more splits than there are cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
