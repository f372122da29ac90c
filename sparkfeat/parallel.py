"""Python functions over rows and columns in Arrow batches, for what no expression says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .spec import FeatureSet


def parallel_apply(df: DataFrame, function: Callable[[dict], object], name: str, kind: str = "double", columns: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: the function of each row's ``columns`` (all by default) as a dict; rows go to Python in Arrow batches."""
    use = columns or df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DataType.fromDDL(kind))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [function(r) for r in b[use].to_dict("records")]})

    return df.mapInPandas(run, schema)


def parallel_transform(df: DataFrame, features: FeatureSet) -> DataFrame:
    """All features in one projection; Spark runs it over all partitions at once."""
    return features.compute_all(df)
