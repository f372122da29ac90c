"""Shared plumbing: connected components, table access, workers that give memory back."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, shared_folder, spread, stored

#: Bytes that a task returns between two times that it gives memory back.
TRIM = 16_000_000

__all__ = ["ceil_tol", "components", "discard", "parts", "shared_folder", "stored", "table", "tidy"]


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of some megabytes: both sides of every task hold one.  A number that the user set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.sparkContext.getConf().get(key) is None and spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def trim() -> None:
    """Gives back to the system what this worker has freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for mapInArrow that gives memory back now and then, and when its partition is done: workers live on, and what they keep they take from other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = 0
        try:
            for b in fn(batches):
                yield b
                moved += b.nbytes
                if moved > TRIM:
                    moved = 0
                    trim()
        finally:
            trim()

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of the undirected edges with the least node of its connected component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the number of rounds grows
    with the logarithm of the longest path, and each round's edges go to the shared folder.
    Empty edges give no rows; loops give their node alone; null ends are dropped.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    nodes = None
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = e
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        nxt = stored(small.where("u <> v").distinct())
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if e is not nodes:
            discard(e)
        e = nxt
        if state == before:
            break
        before = state
    found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return stored(every.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def parts(spark: SparkSession) -> int:
    """Shuffle partitions as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ceil_tol(x: float) -> int:
    """The least integer not below x, with x's rounding error forgiven."""
    return math.ceil(x - 1e-9)
