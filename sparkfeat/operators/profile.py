"""One aggregation over all rows that tells the engines what they need to know of the columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import num, q
from ..spec import FeatureType


@dataclass(frozen=True)
class ColumnProfile:
    n: int
    nulls: int
    distinct: int
    mean: float | None = None
    std: float | None = None
    mean_length: float | None = None


def profile(df: DataFrame, columns: list[str] | None = None, near: Callable[[int, int], bool] | None = None) -> dict[str, ColumnProfile]:
    """Counts of rows are exact; nulls and NaN are missing.  Columns of nested types are left out.

    Distinct values are estimated within some 2 %, in the same aggregation; those of columns for whose
    (rows, estimate) ``near`` holds are then counted exactly, and those of all columns without ``near``.
    """
    fields = [f for f in df.schema.fields if (columns is None or f.name in columns) and FeatureType.of(f.dataType)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, f in enumerate(fields):
        numeric = FeatureType.of(f.dataType) == FeatureType.NUMERIC
        c = F.expr(num(f.name)) if numeric else F.col(q(f.name))
        aggs += [F.count(c).alias(f"c{k}"), F.approx_count_distinct(c, 0.02).alias(f"d{k}")]
        if numeric:
            aggs += [F.avg(c).alias(f"m{k}"), F.stddev_samp(c).alias(f"s{k}")]
        elif FeatureType.of(f.dataType) == FeatureType.CATEGORICAL:
            aggs += [F.avg(F.length(c)).alias(f"l{k}")]
    r = df.agg(*aggs).first().asDict()
    again = [(k, f) for k, f in enumerate(fields) if near is None or near(r["n"], r[f"d{k}"])]
    if again:
        r |= df.agg(*[F.count_distinct(F.expr(num(f.name)) if FeatureType.of(f.dataType) == FeatureType.NUMERIC else F.col(q(f.name))).alias(f"d{k}") for k, f in again]).first().asDict()
    return {f.name: ColumnProfile(r["n"], r["n"] - r[f"c{k}"], r[f"d{k}"], r.get(f"m{k}"), r.get(f"s{k}"), r.get(f"l{k}")) for k, f in enumerate(fields)}
