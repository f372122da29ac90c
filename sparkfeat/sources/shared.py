"""Intermediate tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once an application: the driver's path need not be theirs, under spark-submit least of all."""
    sc, home = spark.sparkContext, Path(__file__).resolve().parent.parent
    if sc.applicationId in _SHIPPED or not home.is_dir():  # in a zip it has been sent already
        return
    folder = tempfile.mkdtemp(prefix="sparkfeat-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(where := f"{folder}/{home.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(where)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one in local mode alone if that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if where is None and jsc.getCheckpointDir().isDefined():
        where = jsc.getCheckpointDir().get()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="sparkfeat-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _path(spark: SparkSession, where: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Spark's setting by which an execution's shuffle files go when it has ended, not when the driver happens to collect garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The shuffle files behind it are removed at once, so a chain of such tables holds the disk of its
    widest step alone.  The table itself goes with ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    ship(spark)
    where = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(where)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    p, fs = _path(spark, where)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(where)
    out._stored_at = where
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for a frame that no later plan reads."""
    where = getattr(df, "_stored_at", None)
    if where:
        p, fs = _path(df.sparkSession, where)
        fs.delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` with a partition for each core at least: files with few row groups are read by few tasks, whatever they cost."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def even(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` with its rows shared out evenly over as many partitions as there are cores, also where most of its partitions are empty.

    By ``key``, which names rows, partitions and the order within them do not depend on how the files were cut.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key).sortWithinPartitions(key) if key else df.repartition(cores)


class Files:
    """Small files and folders on whatever file system a path names: local, HDFS or an object store."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def exists(self, where: str) -> bool:
        p, fs = _path(self.spark, where)
        return fs.exists(p)

    def read(self, where: str) -> str:
        p, fs = _path(self.spark, where)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, where: str, text: str) -> None:
        p, fs = _path(self.spark, where)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def make(self, where: str) -> None:
        p, fs = _path(self.spark, where)
        fs.mkdirs(p)

    def delete(self, where: str) -> bool:
        p, fs = _path(self.spark, where)
        return fs.exists(p) and fs.delete(p, True)

    def move(self, where: str, to: str) -> None:
        p, fs = _path(self.spark, where)
        self.delete(to)
        fs.rename(p, _path(self.spark, to)[0])

    def names(self, folder: str) -> list[str]:
        p, fs = _path(self.spark, folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def is_folder(self, where: str) -> bool:
        p, fs = _path(self.spark, where)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()
