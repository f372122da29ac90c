"""Tables in and out: CSV, Parquet and JSON, by suffix or by name."""

from __future__ import annotations

import hashlib
import json
import time
import warnings
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Files

FORMATS = {"csv": "csv", "parquet": "parquet", "pq": "parquet", "parq": "parquet", "json": "json", "jsonl": "json"}


def detect(path: str, given: str | None = None) -> str:
    name = (given or PurePosixPath(path).suffix.lstrip(".")).lower()
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; known: {sorted(FORMATS)}")
    return FORMATS[name]


def read(spark: SparkSession, path: str, fmt: str | None = None, limit: int | None = None, schema: str | None = None, order_by: list[str] | None = None) -> DataFrame:
    """A table that has columns and rows; ``limit`` keeps the first rows by ``order_by``, or any if that is not given, and warns if there are more."""
    kind = detect(path, fmt)
    try:
        r = spark.read.schema(schema) if schema else spark.read
        if kind == "csv":
            df = r.csv(path, header=True, inferSchema=schema is None)
        elif kind == "json":
            # an array of records spans lines; else each line is a record and files are split
            head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
            df = r.json(path, multiLine=bool(head) and head[0][0].strip().startswith("["))
        else:
            df = r.parquet(path)
    except AnalysisException as e:
        raise ValueError(f"cannot read {path}: {str(e).splitlines()[0]}") from e
    if not df.columns:
        raise ValueError(f"{path} has no columns")
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df if limit is None else head_slice(df, limit, order_by)


def head_slice(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, the same ones each time if ``order_by`` names them; warns if rows are left out."""
    if n < 1:
        raise ValueError("a limit must be positive")
    if df.limit(n + 1).count() > n:
        warnings.warn(f"only the first {n} rows are used", UserWarning, stacklevel=2)
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def write(df: DataFrame, path: str, fmt: str | None = None, single_file: bool = False) -> None:
    """Replaces the table at ``path``, a folder of part files.

    With ``single_file`` it is one file: a JSON one holds an array of records.  A path that names an existing
    folder without a table in it is refused.
    """
    kind = detect(path, fmt)
    files = Files(df.sparkSession)
    if files.is_folder(path) and not any(x == "_SUCCESS" or x.startswith("part-") for x in files.names(path)):
        raise ValueError(f"{path} is a folder")
    if not single_file:
        w = df.write.mode("overwrite")
        w.csv(path, header=True) if kind == "csv" else w.json(path) if kind == "json" else w.parquet(path)
        return
    beside = f"{path}.parts"
    if kind == "json" and df.isEmpty():
        files.delete(path)
        files.write(path, "[]")
        return
    if kind == "json":  # records between brackets, whole table in one task, as one file must be
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        one = df.select(row.alias("value")).coalesce(1)

        def records(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first = True
            for b in it:
                for v in b["value"]:
                    yield pd.DataFrame({"value": [("[" if first else ",") + v]})
                    first = False
            yield pd.DataFrame({"value": ["]"]})

        one.mapInPandas(records, "value string").write.mode("overwrite").text(beside)
    else:
        w = df.coalesce(1).write.mode("overwrite")
        w.csv(beside, header=True) if kind == "csv" else w.parquet(beside)
    part = next(x for x in files.names(beside) if x.startswith("part-"))
    files.move(f"{beside}/{part}", path)
    files.delete(beside)


def with_target(features: DataFrame, df: DataFrame, label: str, key: list[str]) -> DataFrame:
    """``features`` with the label joined back by ``key``; a feature of the label's name is an error."""
    if label in features.columns:
        raise ValueError(f"a feature has the target's name {label!r}")
    return features.join(df.select(*key, label), key, "left")


def split_label(df: DataFrame, label: str) -> DataFrame:
    if label not in df.columns:
        raise ValueError(f"no column {label!r}; columns: {df.columns[:20]}")
    return df


def fingerprint(df: DataFrame) -> str:
    """16 hex digits that depend on the columns and on all rows, not on their order."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first()
    return hashlib.md5(f"{df.dtypes}{r[0]}{r[1]}".encode()).hexdigest()[:16]


class TableCache:
    """Parquet tables by key and fingerprint, with their metadata beside them; the oldest go first beyond ``most``.

    The index is the folder itself, so other processes see what one has put there.
    """

    def __init__(self, folder: str, most: int = 100) -> None:
        self.folder, self.most = folder.rstrip("/"), most

    @property
    def files(self) -> Files:
        return Files(SparkSession.active())

    def _path(self, key: str) -> str:
        return f"{self.folder}/{hashlib.md5(key.encode()).hexdigest()}"

    def _index(self) -> list[tuple[float, str, dict]]:
        got = [json.loads(self.files.read(f"{self.folder}/{x}")) for x in self.files.names(self.folder) if x.endswith(".meta.json")]
        return sorted((d["at"], d["key"], d["meta"]) for d in got)

    def put(self, key: str, df: DataFrame, **meta) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(key))
        self.files.write(f"{self._path(key)}.meta.json", json.dumps({"key": key, "meta": meta, "at": time.time()}))
        for _, old, _ in self._index()[: -self.most]:
            self.delete(old)
        return df.sparkSession.read.parquet(self._path(key))

    def get(self, spark: SparkSession, key: str) -> DataFrame | None:
        return spark.read.parquet(self._path(key)) if self.has(key) else None

    def has(self, key: str) -> bool:
        return self.files.exists(f"{self._path(key)}.meta.json")

    def metadata(self, key: str) -> dict | None:
        return json.loads(self.files.read(f"{self._path(key)}.meta.json"))["meta"] if self.has(key) else None

    def keys(self) -> list[str]:
        return [k for _, k, _ in self._index()]

    def delete(self, key: str) -> bool:
        if not self.files.delete(f"{self._path(key)}.meta.json"):
            return False
        self.files.delete(self._path(key))
        return True

    def clear(self) -> None:
        for k in self.keys():
            self.delete(k)
