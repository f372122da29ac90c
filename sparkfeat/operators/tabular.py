"""Tabular features: powers, products, ratios, differences, scalar transforms, categorical encodings.

``fit`` makes an ordered plan of expressions from one profile; ``transform`` is one projection.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..functions import expr as E
from ..spec import FeatureOrigin, FeatureSet, FeatureSpec, FeatureType, columns_of
from .order import ordered
from .profile import profile


def literal(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


class TabularEngine:
    def __init__(self, polynomial_degree: int = 2, interaction_only: bool = False, include_transforms: list[str] | None = None, max_features: int | None = None, min_distinct: int = 5, encode_categorical: bool = True, one_hot_ratio: float = 0.05, target_ratio: float = 0.5, min_samples_per_category: int = 3, keep_original_categorical: bool = True, max_one_hot: int = 1000) -> None:
        if not 1 <= polynomial_degree <= 4:
            raise ValueError("polynomial_degree must be between 1 and 4")
        names = ["log", "sqrt", "square"] if include_transforms is None else list(include_transforms)
        if unknown := set(names) - set(E.TRANSFORMS):
            raise ValueError(f"unknown transforms: {sorted(unknown)}")
        self.degree, self.interaction_only, self.transforms, self.cap = polynomial_degree, interaction_only, names, max_features
        self.min_distinct, self.encode, self.one_hot_ratio, self.target_ratio = min_distinct, encode_categorical, one_hot_ratio, target_ratio
        self.min_samples, self.keep_original, self.max_one_hot = min_samples_per_category, keep_original_categorical, max_one_hot
        self.features, self.numeric, self.encoded, self.lookups = FeatureSet(), [], [], {}

    def fit(self, df: DataFrame, label: str | None = None) -> "TabularEngine":
        facts = profile(df, [c for c in df.columns if c != label], self._near)
        self.numeric = [c for c in columns_of(df, FeatureType.NUMERIC, [label] if label else []) if facts[c].distinct >= self.min_distinct]
        specs = self._categorical(df, label, facts) if self.encode else []
        specs += self._numeric()
        self.features = FeatureSet(specs if self.cap is None else specs[: self.cap])
        return self

    def _near(self, n: int, distinct: int) -> bool:
        """Whether an estimate of distinct values is so near a threshold that the exact number decides."""
        return any(abs(distinct - t) <= 2 + 0.1 * t for t in (self.min_distinct, self.one_hot_ratio * n, self.target_ratio * n, self.max_one_hot))

    def _numeric(self) -> list[FeatureSpec]:
        c, out = self.numeric, []
        P, I = FeatureOrigin.POLYNOMIAL, FeatureOrigin.INTERACTION
        if not self.interaction_only:
            out += [FeatureSpec(f"{x}_pow{d}", E.power(x, d), P, source_columns=(x,), transformation=f"power {d}", explanation=f"{x} to the power of {d}") for x in c for d in range(2, self.degree + 1)]
        out += [FeatureSpec(f"{a}_x_{b}", E.product(a, b), I, source_columns=(a, b), transformation="product", explanation=f"{a} times {b}") for a, b in combinations(c, 2)]
        out += [FeatureSpec(f"{x}_{E.TRANSFORMS[t][0]}", E.transform(t, x), P, source_columns=(x,), transformation=t, explanation=f"{t} of {x}") for x in c for t in self.transforms]
        out += [FeatureSpec(f"{a}_div_{b}", E.ratio(a, b), I, source_columns=(a, b), transformation="ratio", explanation=f"{a} over {b}") for a, b in combinations(c, 2)]
        out += [FeatureSpec(f"{a}_minus_{b}", E.difference(a, b), I, source_columns=(a, b), transformation="difference", explanation=f"{a} less {b}") for a, b in combinations(c, 2)]
        return out

    def _categorical(self, df: DataFrame, label: str | None, facts: dict) -> list[FeatureSpec]:
        out: list[FeatureSpec] = []
        y = label_as_number(df, label) if label else None
        for c in columns_of(df, FeatureType.CATEGORICAL, [label] if label else []):
            n, distinct = facts[c].n, facts[c].distinct
            if not n or not distinct:
                continue
            counts = df.where(F.col(E.q(c)).isNotNull()).groupBy(F.col(E.q(c)).alias("v")).agg(F.count("*").alias("n")).where(F.col("n") >= self.min_samples)
            if distinct / n <= self.one_hot_ratio and distinct <= self.max_one_hot:
                # a row per kept category comes to the driver, ``max_one_hot`` at most; columns with more categories are encoded by target
                cats = [r["v"] for r in counts.orderBy(F.desc("n"), "v").collect()]
                if not cats:
                    continue
                names = {v: f"{c}_{v}" for v in cats}
                out += [FeatureSpec(names[v], f"cast(coalesce({E.q(c)} = {literal(v)}, false) as int)", FeatureOrigin.CUSTOM, source_columns=(c,), transformation="one-hot", explanation=f"1 where {c} is {v}") for v in cats]
                other = f"{c}_other" if f"{c}_other" not in names.values() else f"{c}_other_"
                inside = ", ".join(literal(v) for v in cats)
                out.append(FeatureSpec(other, f"cast(not coalesce({E.q(c)} in ({inside}), false) as int)", FeatureOrigin.CUSTOM, source_columns=(c,), transformation="one-hot", explanation=f"1 where {c} is none of its frequent values"))
                self.encoded.append(c)
            elif distinct / n <= self.target_ratio and y is not None:
                base = y.where(F.col("__y").isNotNull())
                means = base.where(F.col(E.q(c)).isNotNull()).groupBy(F.col(E.q(c)).alias("v")).agg(F.avg("__y").alias("m"), F.count("*").alias("n")).where(F.col("n") >= self.min_samples).select("v", "m")
                overall = base.agg(F.avg("__y")).first()[0]
                name = f"{c}_target_encoded"
                self.lookups[name] = (c, means, overall)
                out.append(FeatureSpec(name, f"coalesce({E.q('__lookup_' + name)}, {overall!r}D)" if overall is not None else E.q("__lookup_" + name), FeatureOrigin.AGGREGATION, source_columns=(c,), transformation="target mean", explanation=f"mean label where {c} has its value"))
                self.encoded.append(c)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for f in self.features for c in f.source_columns if c in self.numeric and c not in df.columns]
        if missing:
            raise KeyError(f"missing numeric columns: {sorted(set(missing))}")
        specs = [f for f in self.features if f.name not in df.columns and all(c in df.columns for c in f.source_columns)]
        before = df.columns
        for f in specs:
            if f.name in self.lookups:
                c, means, _ = self.lookups[f.name]
                key = f"__key_{f.name}"
                df = df.join(means.select(F.col("v").alias(key), F.col("m").alias("__lookup_" + f.name)), F.col(E.q(c)) == F.col(E.q(key)), "left")
        keep = [c for c in before if self.keep_original or c not in self.encoded]
        return df.select(*[F.col(E.q(c)) for c in keep], *[f.column() for f in specs])

    def fit_transform(self, df: DataFrame, label: str | None = None) -> DataFrame:
        return self.fit(df, label).transform(df)


def label_as_number(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``__y``: the label as double; strings by their rank among the sorted distinct labels."""
    kind = FeatureType.of(df.schema[label].dataType)
    if kind in (FeatureType.NUMERIC, FeatureType.BOOLEAN):
        return df.withColumn("__y", F.col(E.q(label)).cast("int").cast("double") if kind == FeatureType.BOOLEAN else F.expr(E.num(label)))
    codes = label_codes(df, label)
    return df.join(codes.select(F.col("v").alias("__label"), F.col("code").cast("double").alias("__y")), F.col(E.q(label)) == F.col("__label"), "left").drop("__label")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(v, code): distinct values in sorted order from 0; numbered over range partitions."""
    d = df.select(F.col(E.q(column)).cast("string").alias("v")).where("v is not null").distinct()
    return ordered(d, ["v"]).select("v", (F.col("__rank") - 1).alias("code"))


def ordinal_encode(train: DataFrame, test: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames with string columns as codes of the train side's sorted values, null being "missing"; unknown values get the next code."""
    for c in columns:
        fill = lambda d: d.withColumn(c, F.coalesce(F.col(E.q(c)).cast("string"), F.lit("missing")))  # noqa: B023, E731
        codes = label_codes(fill(train), c)
        n = codes.count()
        train, test = (label_encode(fill(d), c, codes, n).drop(c).withColumnRenamed(f"{c}_encoded", c).select(*d.columns) for d in (train, test))
    return train, test


def label_encode(df: DataFrame, column: str, codes: DataFrame | None = None, unknown: int = -1) -> DataFrame:
    """``df`` with ``{column}_encoded``: the fitted code, ``unknown`` for nulls and values not seen."""
    codes = label_codes(df, column) if codes is None else codes
    k = codes.select(F.col("v").alias("__v"), F.col("code").alias("__code"))
    return df.join(k, F.col(E.q(column)).cast("string") == F.col("__v"), "left").select(*[F.col(E.q(c)) for c in df.columns], F.coalesce("__code", F.lit(unknown)).cast("int").alias(f"{column}_encoded"))
