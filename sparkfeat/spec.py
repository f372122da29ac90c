"""Feature specifications: a declarative SQL expression with its provenance, and ordered sets of them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FeatureType(str, Enum):
    NUMERIC = "numeric"
    CATEGORICAL = "categorical"
    DATETIME = "datetime"
    TEXT = "text"
    BOOLEAN = "boolean"

    @classmethod
    def of(cls, kind: T.DataType) -> "FeatureType | None":
        """The class of a Spark type; None for arrays, maps, structs and binaries."""
        if isinstance(kind, T.BooleanType):
            return cls.BOOLEAN
        if isinstance(kind, T.NumericType):
            return cls.NUMERIC
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return cls.DATETIME
        return cls.CATEGORICAL if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)) else None


class FeatureOrigin(str, Enum):
    ORIGINAL = "original"
    POLYNOMIAL = "polynomial"
    INTERACTION = "interaction"
    AGGREGATION = "aggregation"
    TIMESERIES = "timeseries"
    LLM_GENERATED = "llm_generated"
    LLM_SUGGESTED = "llm_suggested"
    CUSTOM = "custom"


def columns_of(df: DataFrame, kind: FeatureType, without: Iterable[str] = ()) -> list[str]:
    skip = set(without)
    return [f.name for f in df.schema.fields if f.name not in skip and FeatureType.of(f.dataType) == kind]


@dataclass(frozen=True)
class FeatureSpec:
    """One output column: ``code`` is its Spark SQL text."""

    name: str
    code: str
    origin: FeatureOrigin = FeatureOrigin.CUSTOM
    dtype: FeatureType = FeatureType.NUMERIC
    source_columns: tuple[str, ...] = ()
    transformation: str = ""
    explanation: str = ""
    importance: float | None = None
    metadata: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if not self.source_columns:
            object.__setattr__(self, "source_columns", (self.name,))

    def column(self) -> Column:
        return F.expr(self.code).alias(self.name)

    def compute(self, df: DataFrame) -> DataFrame:
        return df.select("*", self.column())

    def to_dict(self) -> dict:
        return asdict(self) | {"origin": self.origin.value, "dtype": self.dtype.value, "source_columns": list(self.source_columns)}

    @classmethod
    def from_dict(cls, d: dict) -> "FeatureSpec":
        return cls(**(d | {"origin": FeatureOrigin(d["origin"]), "dtype": FeatureType(d["dtype"]), "source_columns": tuple(d["source_columns"])}))


class FeatureSet:
    """Features by name, in order of addition."""

    def __init__(self, features: Iterable[FeatureSpec] = ()) -> None:
        self._by: dict[str, FeatureSpec] = {f.name: f for f in features}

    def __len__(self) -> int:
        return len(self._by)

    def __iter__(self) -> Iterator[FeatureSpec]:
        return iter(self._by.values())

    def __contains__(self, name: str) -> bool:
        return name in self._by

    def add(self, f: FeatureSpec) -> None:
        self._by[f.name] = f

    def remove(self, name: str) -> FeatureSpec | None:
        return self._by.pop(name, None)

    def get(self, name: str) -> FeatureSpec | None:
        return self._by.get(name)

    @property
    def names(self) -> list[str]:
        return list(self._by)

    def filter_by_origin(self, origin: FeatureOrigin) -> "FeatureSet":
        return FeatureSet(f for f in self if f.origin == origin)

    def filter_by_type(self, kind: FeatureType) -> "FeatureSet":
        return FeatureSet(f for f in self if f.dtype == kind)

    def filter_by_importance(self, least: float) -> "FeatureSet":
        return FeatureSet(f for f in self if f.importance is not None and f.importance >= least)

    def sort_by_importance(self, ascending: bool = False) -> "FeatureSet":
        return FeatureSet(sorted(self, key=lambda f: f.importance or 0.0, reverse=not ascending))

    def with_importances(self, scores: dict[str, float]) -> "FeatureSet":
        return FeatureSet(replace(f, importance=scores.get(f.name, f.importance)) for f in self)

    def merge(self, other: "FeatureSet") -> "FeatureSet":
        return FeatureSet([*self, *other])

    def explanations(self) -> dict[str, str]:
        return {f.name: f.explanation for f in self if f.explanation}

    def compute_all(self, df: DataFrame) -> DataFrame:
        """All features in one projection; those that do not resolve are skipped."""
        good = []
        for f in self:
            try:
                df.select(f.column())
                good.append(f.column())
            except Exception:  # noqa: BLE001 - an unresolvable expression
                continue
        return df.select("*", *good)

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        schema = "name string, dtype string, origin string, source_columns array<string>, transformation string, explanation string, code string, importance double"
        return spark.createDataFrame([(f.name, f.dtype.value, f.origin.value, list(f.source_columns), f.transformation, f.explanation, f.code, f.importance) for f in self], schema)

    def to_json(self) -> str:
        return json.dumps([f.to_dict() for f in self], indent=1)

    @classmethod
    def from_json(cls, text: str) -> "FeatureSet":
        return cls(FeatureSpec.from_dict(d) for d in json.loads(text))
