"""Tables written to the folder that the whole cluster shares, and read from there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: the folder that a local session without spark.checkpoint.dir uses, the paths written, and the tables kept by key.
_LOCAL: dict[str, str] = {}
_PATHS: dict[str, list[str]] = {}
_KEPT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder of setCheckpointDir. A local session without either uses a temporary folder; elsewhere it is an error, as executors don't share their disks."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="docscreen-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[context.applicationId] = "file://" + folder
    return _LOCAL[context.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def save(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table and read it back: cuts lineage, survives lost executors."""
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    order = [f for f in df.schema.fields if f.name not in partition_by] + [f for f in df.schema.fields if f.name in partition_by]
    return df.sparkSession.read.schema(type(df.schema)(order)).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at, fs = _hadoop(spark, path)
    fs.delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; no DataFrame that reads it may be used afterwards."""
    app = spark.sparkContext.applicationId
    for path in _PATHS.pop(app, []):
        remove(spark, path)
    for key in [k for k in _KEPT if k[0] == app]:
        del _KEPT[key]


def state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Time of change and size of a file or folder."""
    at, fs = _hadoop(spark, path)
    return fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()


def written(spark: SparkSession, key: str, sources: list[str], make) -> DataFrame:
    """The table that make() gives, written once for this application and state of its sources."""
    at = (spark.sparkContext.applicationId, key, *(state(spark, s) for s in sources))
    if at not in _KEPT:
        df, cores = make(), spark.sparkContext.defaultParallelism
        # A small source file comes as one partition; what is made of its rows is worth all cores. Larger ones stay as they are split.
        few = df.rdd.getNumPartitions() < cores
        path = shared_path(spark, "table")
        save(df.repartition(cores) if few else df, path)
        _KEPT[at] = path
    return spark.read.parquet(_KEPT[at])
