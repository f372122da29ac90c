"""Feature store: views as Parquet with a JSON manifest, point-in-time reads, latest values."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Files


def latest(df: DataFrame, keys: list[str], ts: str, tie: list[str] | None = None) -> DataFrame:
    """The last row of each key: one aggregation, so only one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(ts, *(tie or []))).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def as_of(entities: DataFrame, features: DataFrame, keys: list[str], ts: str, feature_ts: str | None = None, ttl_seconds: float | None = None, values: list[str] | None = None) -> DataFrame:
    """Each entity row with the last feature values at or before its time, null beyond ``ttl_seconds``.

    Both sides are united and one window per key carries the last values on: one shuffle, and no
    pair of rows is ever formed.  Of feature rows of one time the greatest by value wins.
    """
    fts = feature_ts or ts
    values = values or [c for c in features.columns if c not in keys and c != fts]
    names = [v if v not in entities.columns else f"{v}_feature" for v in values]
    pack = F.struct(F.col(fts).cast("timestamp").alias("__t"), *[F.col(v).alias(n) for v, n in zip(values, names)])
    e = entities.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(ts).cast("timestamp").alias("__ts"), F.struct(*entities.columns).alias("__e"), F.lit(1).alias("__side"))
    f = features.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(fts).cast("timestamp").alias("__ts"), pack.alias("__f"), F.lit(0).alias("__side")).where(F.col("__ts").isNotNull())
    both = e.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__ts", "__side", "__f").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("__last", F.last("__f", ignorenulls=True).over(w)).where("__side = 1")
    ok = F.col("__last").isNotNull()
    for i in range(len(keys)):
        ok = ok & F.col(f"__k{i}").isNotNull()
    if ttl_seconds is not None:
        ok = ok & (F.unix_micros("__ts") - F.unix_micros("__last.__t") <= int(ttl_seconds * 1e6))
    return got.select(*[F.col(f"__e.{c}").alias(c) for c in entities.columns], *[F.when(ok, F.col(f"__last.{n}")).alias(n) for n in names])


@dataclass
class View:
    name: str
    entities: list[str]
    timestamp: str
    ttl_days: float = 365.0
    description: str = ""
    tags: dict = field(default_factory=dict)
    schema: str = ""


class FeatureStore:
    """Views as Parquet with a JSON manifest each, under a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str, feature_prefix: str = "") -> None:
        self.spark, self.folder, self.prefix, self.files = spark, folder.rstrip("/"), feature_prefix, Files(spark)

    def __enter__(self) -> "FeatureStore":
        self.files.make(self.folder)
        return self

    def __exit__(self, *_) -> None:
        return None

    def _at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _view(self, name: str) -> View:
        if not self.files.exists(self._at(f"{name}.json")):
            raise KeyError(f"no view {name!r}")
        return View(**json.loads(self.files.read(self._at(f"{name}.json"))))

    def save(self, df: DataFrame, name: str, entities: list[str], timestamp: str | None = None, **meta) -> View:
        if not entities or (missing := [c for c in entities if c not in df.columns]):
            raise ValueError(f"entity columns are required and must exist: {entities if not entities else missing}")
        ts = timestamp or "event_timestamp"
        if ts not in df.columns:
            df = df.withColumn(ts, F.current_timestamp())
        if self.prefix:
            df = df.select(*[F.col(c).alias(c if c in (*entities, ts) else self.prefix + c) for c in df.columns])
        df.write.mode("overwrite").parquet(self._at(name))
        v = View(name, list(entities), ts, schema=df.schema.json(), **meta)
        self.files.write(self._at(f"{name}.json"), json.dumps(asdict(v)))
        return v

    def schema(self, name: str) -> dict:
        """The view's schema as saved, without reading its data."""
        return json.loads(self._view(name).schema)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(self._view(name).name))

    def historical(self, entities: DataFrame, name: str, ts: str, features: list[str] | None = None) -> DataFrame:
        v = self._view(name)
        return as_of(entities, self.read(name), v.entities, ts, v.timestamp, v.ttl_days * 86400, features)

    def materialise(self, name: str) -> None:
        v = self._view(name)
        d = self.read(name)
        d = d.where(F.col(v.timestamp) >= F.current_timestamp() - F.make_dt_interval(F.lit(int(v.ttl_days)))) if v.ttl_days else d
        latest(d, v.entities, v.timestamp).write.mode("overwrite").parquet(self._at(f"{name}__online"))

    def push(self, name: str, rows: DataFrame) -> None:
        """New rows into the latest-value table, which is rewritten beside the old one and then swapped in."""
        v = self._view(name)
        at, new = self._at(f"{name}__online"), self._at(f"{name}__online_new")
        old = self.spark.read.parquet(at) if self.files.exists(at) else None
        both = rows if old is None else old.unionByName(rows.select(*old.columns))
        latest(both, v.entities, v.timestamp).write.mode("overwrite").parquet(new)
        self.files.move(new, at)

    def online(self, entities: DataFrame, name: str) -> DataFrame:
        v = self._view(name)
        return entities.join(self.spark.read.parquet(self._at(f"{name}__online")), v.entities, "left")

    def online_dict(self, entities: DataFrame, name: str) -> dict[str, list]:
        """The latest values of a few entities, as one list for each column."""
        rows = self.online(entities, name)
        got = rows.collect()
        return {c: [r[c] for r in got] for c in rows.columns}

    def views(self) -> list[str]:
        return [x[:-5] for x in self.files.names(self.folder) if x.endswith(".json")]

    def delete(self, name: str) -> bool:
        if not self.files.delete(self._at(f"{name}.json")):
            return False
        for x in (name, f"{name}__online"):
            self.files.delete(self._at(x))
        return True

    def close(self) -> None:
        """Nothing is held open; here for symmetry with stores that do."""
