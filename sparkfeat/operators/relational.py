"""Features from related tables and from groups of the table itself.

Each relationship is one aggregation of the related table by its key and one left join; Spark
broadcasts the aggregate where its measured size allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import num, q
from ..spec import FeatureType, columns_of

DEFAULT = ("mean", "sum", "count", "max", "min")


def aggregate(name: str, c: Column, order: list[str] | None = None) -> Column:
    """One aggregate over non-null values; sum of none is 0, std is that of a sample."""
    if name in ("first", "last"):
        if not order:
            raise ValueError(f"{name} needs order_cols")
        pick = F.min_by if name == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), F.struct(*order)))
    table = {"mean": F.avg, "sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)), "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "median": F.median, "nunique": F.count_distinct}
    return table[name](c)


#: What comes from the counts of distinct values.
COUNTED = ("median", "nunique")


def from_value_counts(df: DataFrame, by: str, column: str, key: str, names: dict[str, str]) -> DataFrame:
    """(key, names): median and number of distinct values of a column, exactly, from how often each value occurs.

    Values are counted before they are shuffled, so a key's repeated values cost one row; the running
    count over a key's distinct values finds the middle ones, and no buffer grows with a key.
    """
    x = F.expr(num(column))
    counts = df.groupBy(F.col(q(by)).alias(key), x.alias("x")).agg(F.count("*").alias("k"))
    if "median" in names:
        w = Window.partitionBy(key).orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        has = F.when(F.col("x").isNotNull(), F.col("k")).otherwise(0)
        counts = counts.withColumns({"upto": F.sum(has).over(w), "n": F.sum(has).over(Window.partitionBy(key))})
        low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
        at = lambda place: F.min(F.when(F.col("x").isNotNull() & (F.col("upto") >= place), F.col("x")))
    made = {"median": lambda: (at(low) + at(high)) / 2, "nunique": lambda: F.count("x")}
    return counts.groupBy(key).agg(*[made[a]().alias(n) for a, n in names.items()])


KNOWN = ("mean", "sum", "min", "max", "count", "std", "median", "first", "last", "nunique")


@dataclass(frozen=True)
class Relationship:
    parent: str
    child_key: str
    parent_key: str
    order_cols: tuple[str, ...] = ()


class RelationalEngine:
    """``stats="transform"`` takes group statistics from the frame transformed, ``"fit"`` from the one fitted."""

    def __init__(self, aggregation_functions: list[str] | None = None, stats: str = "transform", max_categorical: int = 3, max_numeric: int = 5) -> None:
        names = DEFAULT if aggregation_functions is None else aggregation_functions
        self.functions = [a for a in names if a in KNOWN]
        self.relationships: list[Relationship] = []
        self.stats, self.max_categorical, self.max_numeric, self._groups = stats, max_categorical, max_numeric, None

    def add_relationship(self, parent: str, child_key: str, parent_key: str | None = None, order_cols: tuple[str, ...] = ()) -> "RelationalEngine":
        r = Relationship(parent, child_key, parent_key or child_key, tuple(order_cols))
        if r not in self.relationships:
            self.relationships.append(r)
        return self

    def _lookups(self, child: DataFrame, related: dict[str, DataFrame]) -> DataFrame:
        for k, r in enumerate(self.relationships):
            if r.parent not in related:
                continue
            p = related[r.parent]
            if r.child_key not in child.columns:
                raise ValueError(f"child key {r.child_key!r} is not a column")
            if r.parent_key not in p.columns:
                raise ValueError(f"parent key {r.parent_key!r} is not a column of {r.parent}")
            values = columns_of(p, FeatureType.NUMERIC, [r.parent_key])
            names = [(c, a, f"{r.parent}_{c}_{a}") for c in values for a in self.functions]
            names = [(c, a, n) for c, a, n in names if n not in child.columns]
            if not names:
                continue
            key = f"__key{k}"
            p = p.where(F.col(q(r.parent_key)).isNotNull())
            plain = [(c, a, n) for c, a, n in names if a not in COUNTED]
            if plain:
                agg = p.groupBy(F.col(q(r.parent_key)).alias(key)).agg(*[aggregate(a, F.expr(num(c)), list(r.order_cols)).alias(n) for c, a, n in plain])
                child = child.join(agg, F.col(q(r.child_key)) == F.col(key), "left").drop(key)
            for c in dict.fromkeys(c for c, a, _ in names if a in COUNTED):
                agg = from_value_counts(p, r.parent_key, c, key, {a: n for d, a, n in names if d == c and a in COUNTED})
                child = child.join(agg, F.col(q(r.child_key)) == F.col(key), "left").drop(key)
            child = child.select(*[F.col(q(x)) for x in child.columns if x not in {n for *_, n in names}], *[F.col(q(n)) for *_, n in names])
        return child

    def _chosen(self, df: DataFrame) -> tuple[list[str], list[str]]:
        return columns_of(df, FeatureType.CATEGORICAL)[: self.max_categorical], columns_of(df, FeatureType.NUMERIC)[: self.max_numeric]

    def fit(self, child: DataFrame, related: dict[str, DataFrame] | None = None) -> "RelationalEngine":
        wide = self._lookups(child, related or {})
        if self.stats == "fit":
            cats, nums = self._chosen(wide)
            self._groups = {c: wide.where(F.col(q(c)).isNotNull()).groupBy(F.col(q(c)).alias(f"__g_{c}")).agg(*[x for n in nums for x in (F.avg(F.expr(num(n))).alias(f"{n}_by_{c}_mean"), F.count(F.expr(num(n))).alias(f"{n}_by_{c}_count"))]) for c in cats}
        return self

    def transform(self, child: DataFrame, related: dict[str, DataFrame] | None = None) -> DataFrame:
        wide = self._lookups(child, related or {})
        cats, nums = self._chosen(wide)
        if self.stats == "fit":
            for c, g in (self._groups or {}).items():
                wide = wide.join(g, F.col(q(c)) == F.col(q(f"__g_{c}")), "left").drop(f"__g_{c}")
            return wide
        return group_statistics(wide, cats, nums)

    def fit_transform(self, child: DataFrame, related: dict[str, DataFrame] | None = None) -> DataFrame:
        return self.fit(child, related).transform(child, related)


def group_statistics(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """``df`` with ``{num}_by_{cat}_mean`` and ``_count`` on every row; null where the category is null.

    Aggregated per category and joined back: partial aggregation leaves nothing of a frequent
    category's skew, which a window over the rows would sort in one task.
    """
    for c in categories:
        stats = df.where(F.col(q(c)).isNotNull()).groupBy(F.col(q(c)).alias("__g")).agg(*[x for n in numbers for x in (F.avg(F.expr(num(n))).alias(f"{n}_by_{c}_mean"), F.count(F.expr(num(n))).alias(f"{n}_by_{c}_count"))])
        df = df.join(stats, F.col(q(c)) == F.col("__g"), "left").drop("__g")
    return df
