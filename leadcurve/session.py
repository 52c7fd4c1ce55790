"""Session settings, and staging of intermediate tables in shared storage.

``stage`` writes a table once, as Parquet, under the folder the cluster names in
``spark.checkpoint.dir`` and reads it back. That cuts lineage, survives the loss
of executors, keeps column pruning and pushdown for what follows, and gives the
optimizer a true size: a small lookup is then broadcast because it was measured
below ``spark.sql.autoBroadcastJoinThreshold``, and a large one is joined by a
shuffle that adaptive execution may split where it is skewed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []
_local_scratch: list[tempfile.TemporaryDirectory] = []

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "leadcurve", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_scratch:
        # removed when the interpreter ends
        _local_scratch.append(tempfile.TemporaryDirectory(prefix="leadcurve-"))
    return _local_scratch[0].name


def checkpoint_folder(spark: SparkSession) -> str:
    """Where iterative fits cut their lineage: the shared folder, unless the session names another."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
    return context.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, keys: Sequence[str], by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Written once to the shared folder as buckets of ``keys``, in folders of ``by``, and read back.

    What groups by ``keys`` afterwards needs no shuffle, and a filter or join on ``by`` reads
    only its folders. ``buckets`` should grow with the table; by default there are as many as
    shuffle partitions.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    # one task per bucket, so that a bucket is one file in each folder
    writer = df.repartition(buckets, *keys).write.format("parquet").option("compression", "zstd").option("path", path)
    writer = writer.partitionBy(*by) if by else writer
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    _staged.append(path)
    return spark.table(table)


@contextmanager
def owned_stages(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed when the block ends, also by an error.

    For jobs that write their results: a frame that still reads a staged table must be
    written before the block ends.
    """
    began = len(_staged)
    try:
        yield
    finally:
        for path in _staged[began:]:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        del _staged[began:]


def spread_by_range(df: DataFrame, *columns: str) -> DataFrame:
    """Partition by ranges of ``columns``, as many as ``spread`` makes."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(max(configured, df.sparkSession.sparkContext.defaultParallelism), *columns)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` before rows unfold.

    The number of partitions is given, so adaptive execution does not merge
    partitions that are small only until each row turns into many.
    """
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(configured, spark.sparkContext.defaultParallelism), *keys)
