"""Tables written once and read again, to cut lineage where every executor can see them.

The folder comes from ``spark.checkpoint.dir``. Where that setting is missing a
local master gets a folder of its own; a cluster gets an error, since a
machine-local folder is not seen by the other machines.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _LOCAL


_LOCAL: str | None = None
BATCH_BYTES = "1m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Whole texts go to Python at most ``BATCH_BYTES`` at a time, unless the session sets its own bound; a batch is held several times over on both sides."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Plans that run meanwhile delete their shuffle files when they end, which else stay until the driver collects garbage; a setting of the session's own holds."""
    if _FREE_SHUFFLES in spark.conf.getAll:
        yield
        return
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with _shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path  # for drop()
    _MADE.append(out)
    return out


_MADE: list[DataFrame] = []


def finished(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that ``build`` plans, written once; whatever it materialised on the way is deleted."""
    mark = len(_MADE)
    out = materialize(build(), label)
    drop(*_MADE[mark:-1])
    del _MADE[mark:]
    return out


def spread(table: DataFrame, key: str) -> DataFrame:
    """A scan whose splits would leave half of the cores or more idle, dealt over them by ``key``; any other as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if 2 * table.rdd.getNumPartitions() <= cores else table


def drop(*tables: DataFrame) -> None:
    """Delete tables from :func:`materialize` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_corvane_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
