"""Streams: a fitted plan is stateless per row, so it runs on a stream; pushes go to the store by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import FeatureStore


def transform_stream(stream: DataFrame, engine) -> DataFrame:
    return engine.transform(stream)


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and sum of ``value`` per key and window; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("sum"))


def push_stream(stream: DataFrame, store: FeatureStore, view: str, checkpoint: str) -> StreamingQuery:
    """Upserts by micro-batch; a batch that is replayed gives the same latest values."""
    return stream.writeStream.foreachBatch(lambda df, _: store.push(view, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
