"""Session building and the two places where the engine touches shared state:
where lineage is cut, and how far an input is spread before Python runs on it."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
#: Bytes of rows that a task of a large shuffle reads, about.
PARTITION = 32 << 20


def build_session(app: str = "millrace", cpus: int | str = "*", **extra: str) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This session's folder in the one that ``spark.checkpoint.dir`` names.

    It is deleted when the session's program ends. Only a session on one machine
    (``local`` or ``local[...]``) without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _FOLDERS[sc.applicationId] = f"{(configured or tempfile.mkdtemp(prefix='millrace-')).rstrip('/')}/cuts-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, _FOLDERS[sc.applicationId])
    return _FOLDERS[sc.applicationId]


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone, and its folder is the cluster's to clear
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder, and read from there.

    Used where a result is read several times, so that lost executors can't
    cause the work before it to be repeated in every reader. A table is smaller
    than a checkpoint of rows and tells the planner its size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    cut = spark.read.schema(df.schema).parquet(path)
    cut._cut_at = path
    return cut


@contextmanager
def room_for(spark: SparkSession, size: int, each: int = PARTITION) -> Iterator[None]:
    """Shuffles run inside have at least a partition for every ``each`` bytes of
    ``size``, so that a task's share doesn't grow with the table. Adaptive
    execution still merges small ones and splits hot ones, which it wouldn't do
    after an explicit repartition."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), -(-size // each))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(df: DataFrame) -> None:
    """Deletes what ``cut_lineage`` wrote for ``df``, which nothing reads any more,
    and lets Spark remove the shuffle files of work that is done."""
    if hasattr(df, "_cut_at"):
        _delete(df.sparkSession, df._cut_at)
        gc.collect()
        df.sparkSession._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are task slots.

    Only inputs that are too few files for the cluster are moved; a large
    table has more splits than slots and passes through untouched.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)
