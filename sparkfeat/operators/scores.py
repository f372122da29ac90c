"""Feature scores against a label, redundancy, and the selector.

Scores of many features come from aggregations as wide as the features, so rows are never multiplied by
them; correlations of many features from partial Gram matrices that each task adds up in NumPy.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from decimal import Decimal
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import num, q
from ..functions.stats import correlation as pearson
from ..spec import FeatureType, columns_of
from ..sources.shared import discard, even, stored
from .order import ordered, sums_before
from .splits import stratified
from .tabular import label_as_number, label_codes, label_encode

METHODS = ("mutual_info", "f_test", "chi2", "correlation", "importance")


def is_classification(df: DataFrame, label: str) -> bool:
    """Strings and booleans are classes; integers are if they have few distinct values for their number."""
    kind = df.schema[label].dataType
    if FeatureType.of(kind) != FeatureType.NUMERIC:
        return True
    if kind.typeName() in ("float", "double", "decimal") or kind.typeName().startswith("decimal"):
        return False
    r = df.agg(F.count(q(label)).alias("n"), F.count_distinct(q(label)).alias("d")).first()
    return r["d"] <= 0.1 * r["n"]


def _x(f: str):
    return F.coalesce(F.expr(num(f)), F.lit(0.0))


def _melted(row: DataFrame, features: list[str], parts: dict[str, str]) -> DataFrame:
    """(feature, *parts) of a frame with a column ``{part}{k}`` for each part and feature; other columns stay."""
    made = {x for p in parts for x in (f"{p}{k}" for k in range(len(features)))}
    keep = [c for c in row.columns if c not in made]
    at = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{p}{k}").cast(kind).alias(p) for p, kind in parts.items()]) for k, f in enumerate(features)])).alias("__p")
    return row.select(*keep, at).select(*keep, "__p.*")


def _correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, r, n): Pearson correlation with ``__y``, in one aggregation as wide as the features."""
    d = df.select(F.col("__y"), *[_x(f).alias(f"x{k}") for k, f in enumerate(features)])
    row = d.agg(F.count("*").alias("n"), *[pearson(f"x{k}", "__y").alias(f"r{k}") for k in range(len(features))])
    return _melted(row, features, {"r": "double"})


def correlation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, score): absolute Pearson correlation, 0 where undefined."""
    return _correlations(label_as_number(df, label), features).select("feature", F.coalesce(F.abs("r"), F.lit(0.0)).alias("score"))


def _by_class(df: DataFrame, features: list[str], label: str, aggs) -> DataFrame:
    """A row for each class: its number of rows as ``n`` and ``aggs`` of each feature, null labels left out."""
    d = df.where(F.col(q(label)).isNotNull()).select(F.col(q(label)).alias("y"), *[_x(f).alias(f"x{k}") for k, f in enumerate(features)])
    return d.groupBy("y").agg(F.count("*").alias("n"), *[a for k in range(len(features)) for a in aggs(k)])


def f_test(df: DataFrame, features: list[str], label: str, classification: bool | None = None) -> DataFrame:
    """(feature, score): one-way ANOVA F for classes, r**2 / (1 - r**2) * (n - 2) otherwise; 0 where undefined."""
    if classification is None:
        classification = is_classification(df, label)
    if not classification:
        d = _correlations(label_as_number(df, label), features)
        r2 = F.pow("r", F.lit(2))
        return d.select("feature", F.coalesce(F.when(r2 < 1, r2 / (1 - r2) * (F.col("n") - 2)), F.lit(0.0)).alias("score"))
    by = _by_class(df, features, label, lambda k: (F.avg(f"x{k}").alias(f"m{k}"), F.var_pop(f"x{k}").alias(f"v{k}")))
    by = _melted(by, features, {"m": "double", "v": "double"})
    n, k = F.sum("n"), F.count("*")
    grand = F.sum(F.col("n") * F.col("m")) / n
    ssw = F.sum(F.col("n") * F.col("v"))
    ssb = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    return by.groupBy("feature").agg(F.coalesce(F.when((k > 1) & (n > k) & (ssw > 0), (ssb / (k - 1)) / (ssw / (n - k))), F.lit(0.0)).alias("score"))


def chi2(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, score): over classes, squared deviation of the sum of x - min + 1e-8 from its expectation."""
    by = _by_class(df, features, label, lambda k: (F.sum(f"x{k}").alias(f"s{k}"), F.min(f"x{k}").alias(f"lo{k}")))
    by = _melted(by, features, {"s": "double", "lo": "double"})
    all_ = by.groupBy("feature").agg(F.min("lo").alias("low"), F.sum("n").alias("rows"), F.sum("s").alias("sum"))
    by = by.join(all_, "feature")  # a row per feature and class on either side
    o = F.col("s") + F.col("n") * (1e-8 - F.col("low"))
    e = (F.col("sum") + F.col("rows") * (1e-8 - F.col("low"))) * F.col("n") / F.col("rows")
    return by.groupBy("feature").agg(F.sum((o - e) * (o - e) / e).alias("score"))


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 16, classification: bool | None = None, binning: str = "width") -> DataFrame:
    """(feature, score): mutual information in nats of the binned feature and the label (binned too if numeric).

    Bins are of equal width, or, with ``binning="quantile"``, hold as many rows each, up to ties and the quantiles' error of 0.1 %.
    Rows are counted by feature, bin and class before they are shuffled.
    """
    if binning not in ("width", "quantile"):
        raise ValueError("binning is width or quantile")
    if classification is None:
        classification = is_classification(df, label)
    d = df.where(F.col(q(label)).isNotNull())
    d = d if classification else label_as_number(d, label)
    names = [f"x{k}" for k in range(len(features))] + ([] if classification else ["y"])
    d = d.select(F.col(q(label) if classification else "__y").alias("y"), *[_x(f).alias(f"x{k}") for k, f in enumerate(features)])
    if binning == "width":
        edge = d.agg(*[a for c in names for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()

        def cut(c: str):
            lo, hi = edge[f"lo_{c}"], edge[f"hi_{c}"]
            return F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1))) if lo is not None and hi > lo else F.lit(0).cast("long")
    else:
        at = d.agg(*[F.percentile_approx(c, [b / bins for b in range(1, bins)], 1000).alias(f"q_{c}") for c in names]).first()

        def cut(c: str):
            steps = sorted(set(at[f"q_{c}"] or []))
            return sum([(F.col(c) > s).cast("long") for s in steps], F.lit(0).cast("long"))

    cells = d.select((F.col("y") if classification else cut("y")).alias("y"), *[cut(f"x{k}").alias(f"b{k}") for k in range(len(features))])
    at = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"b{k}").cast("long").alias("b")) for k, f in enumerate(features)])).alias("p")
    cell = cells.select("y", at).groupBy("p.feature", "p.b", "y").agg(F.count("*").alias("k"))
    one = Window.partitionBy("feature")
    cell = cell.withColumns({"n": F.sum("k").over(one), "kb": F.sum("k").over(Window.partitionBy("feature", "b")), "ky": F.sum("k").over(Window.partitionBy("feature", "y"))})
    p = F.col("k") / F.col("n")
    return cell.groupBy("feature").agg(F.greatest(F.sum(p * F.log(F.col("k") * F.col("n") / (F.col("kb") * F.col("ky")))), F.lit(0.0)).alias("score"))


def gram_correlation(df: DataFrame, features: list[str]) -> np.ndarray:
    """Pairwise-complete Pearson matrix of numeric columns in one scan, masked for nulls and centred first.

    Tasks give a row of their partial sums for each feature; a shuffle adds them up by feature, so the driver gets
    as many rows as there are features, whatever the number of tasks.
    """
    k = len(features)
    centre = df.agg(*[F.avg(F.expr(num(f))).alias(f"m{i}") for i, f in enumerate(features)]).first()
    mid = np.array([c if c is not None else 0.0 for c in centre])

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((k, 4, k))
        for b in it:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(float) - mid
            m = np.isfinite(x).astype(float)
            x = np.where(m > 0, x, 0.0)
            acc += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array([r.tobytes() for r in acc], pa.binary())], names=["i", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in t.column("sums")], axis=0)
        return pa.table({"i": t.column("i")[:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = df.select(*[F.expr(num(f)).alias(f"x{i}") for i, f in enumerate(features)]).mapInArrow(partial, "i int, sums binary").groupBy("i").applyInArrow(add, "i int, sums binary").collect()
    n, s, s2, xy = (np.stack([np.frombuffer(r["sums"]).reshape(4, k)[j] for r in sorted(rows, key=lambda r: r["i"])]) for j in range(4))
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = xy - s * s.T / n
        var = s2 - s * s / n
        return cov / np.sqrt(var * var.T)


def _average_ranks(d: DataFrame, c: str) -> DataFrame:
    """(v, r): each distinct value's average rank; only the counts of values are ordered, over range partitions."""
    by = sums_before(d.groupBy(c).agg(F.count("*").alias("k")), [c], "k", "before")
    return by.select(F.col(c).alias(f"v{c}"), (F.col("before") + (F.col("k") + 1) / 2).alias(f"r{c}"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(score): Pearson correlation of average ranks of the rows where both are present."""
    d = df.select(F.expr(num(a)).alias("a"), F.expr(num(b)).alias("b")).where("a is not null and b is not null")
    d = d.join(_average_ranks(d, "a"), F.col("a") == F.col("va")).join(_average_ranks(d, "b"), F.col("b") == F.col("vb"))
    return d.agg(pearson("ra", "rb").alias("score"))


def _inversions(key: np.ndarray, w: np.ndarray) -> int:
    """Sum of w[i] * w[j] over i < j with key[i] > key[j], a bit of the keys at a time: n log n, in memory of a few n."""
    w, total = w.astype(np.int64 if int(w.sum()) < 1 << 31 else object), 0
    for bit in range(int(key.max(initial=0)).bit_length() - 1, -1, -1):
        # rows lie by the bits above, then in their first order; those with the bit come late but stand before
        high, group = (key >> bit) & 1, key >> (bit + 1)
        before = np.cumsum(w * high)
        start = np.flatnonzero(np.diff(group, prepend=-1))
        before -= np.repeat(before[start] - (w * high)[start], np.diff(start, append=len(key)))
        total += int((w * before)[high == 0].sum())
        at = np.argsort(key >> bit, kind="stable")
        key, w = key[at], w[at]
    return total


def kendall(df: DataFrame, a: str, b: str, block: int = 4096) -> float | None:
    """Kendall's tau-b over all rows, None where undefined: what is left of all pairs without the tied and twice the discordant ones.

    Distinct pairs of values have a place by (a, b) and one by (b, a); two of them are discordant where these differ in
    order, for tied ones do not.  Both orders are cut into blocks of as many places each, 512 at most: discordant pairs within a block of
    one order or the other are counted in a task for each block, n log n, those apart in both from the weights where blocks meet.
    """
    d = df.select(F.expr(num(a)).alias("a"), F.expr(num(b)).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("w"))
    d = stored(d)
    n, cells, same = d.agg(F.sum("w"), F.count("*"), F.sum(_pairs("w"))).first()
    tied = lambda c: int(d.groupBy(c).agg(F.sum("w").alias("k")).agg(F.sum(_pairs("k"))).first()[0] or 0)
    n, same = n or 0, int(same or 0)
    total, tied_a, tied_b = n * (n - 1) // 2, tied("a"), tied("b")
    if total - tied_a <= 0 or total - tied_b <= 0:
        return None
    block = max(block, -(-cells // 512))
    at = ordered(ordered(d, ["a", "b"], "r"), ["b", "a"], "s").select("w", (F.col("r") - 1).alias("r"), (F.col("s") - 1).alias("s"))
    at = stored(at.withColumns({"p": F.floor(F.col("r") / block), "q": F.floor(F.col("s") / block)}))

    def within(order: str, key: str):
        def count(t: pa.Table) -> pa.Table:
            place, k, w = (t.column(c).to_numpy() for c in (order, key, "w"))
            by = np.argsort(place)
            return pa.table({"d": pa.array([Decimal(_inversions(k[by], w[by]))], pa.decimal128(38, 0))})

        return count

    counted = lambda c, order, key: at.groupBy(c).applyInArrow(within(order, key), "d decimal(38,0)").agg(F.sum("d")).first()[0]
    # of one block by (a, b), then of one by (b, a) and not of one by (a, b), then of neither
    discordant = int(counted("p", "r", "s")) + int(counted("q", "s", "p"))
    meet = at.groupBy("p", "q").agg(F.sum("w").alias("w")).toArrow()
    p, q_, w = (meet.column(c).to_numpy() for c in ("p", "q", "w"))
    weight = np.zeros((int(p.max()) + 1, int(q_.max()) + 2), dtype=object)
    weight[p, q_] = w
    above = np.zeros(weight.shape[1], dtype=object)  # of blocks before in p: the weight at q and beyond
    for row in weight:
        discordant += int((row[:-1] * above[1:]).sum())
        above = above + np.cumsum(row[::-1])[::-1]
    discard(at)
    discard(d)
    return (total - tied_a - tied_b + same - 2 * discordant) / math.sqrt((total - tied_a) * (total - tied_b))


def _pairs(weight: str):
    k = F.col(weight).cast("decimal(19,0)")
    return k * (k - 1) / 2


def redundant(features: list[str], corr: np.ndarray, importance: dict[str, float], originals: set[str], threshold: float = 0.95) -> set[str]:
    """Columns to drop: of a pair at or above the threshold a derived one yields to an original, else the less important."""
    gone: set[str] = set()
    for i, a in enumerate(features):
        if a in gone:
            continue
        for j in range(i + 1, len(features)):
            b = features[j]
            if b in gone or not abs(corr[i, j]) >= threshold or (a in originals and b in originals):
                continue
            if a in originals or (b not in originals and importance.get(a, 0) >= importance.get(b, 0)):
                gone.add(b)
            else:
                gone.add(a)
                break
    return gone


def assemble(df: DataFrame, features: list[str], label: str, classification: bool):
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    d = df.where(F.col(q(label)).isNotNull()).select(*[_x(f).alias(f"x{i}") for i, f in enumerate(features)], F.col(q(label)).alias("y0"))
    if classification:
        d = d.withColumn("y0", F.col("y0").cast("string"))
        d = StringIndexer(inputCol="y0", outputCol="y", stringOrderType="alphabetAsc").fit(d).transform(d)
    else:
        d = d.withColumn("y", F.col("y0").cast("double"))
    return VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="v").transform(d)


def importances(df: DataFrame, features: list[str], label: str, model: str = "random_forest", trees: int = 100, depth: int = 5, seed: int = 42, sample: float = 1.0) -> dict[str, float]:
    """Tree importances; boosting of more than two classes is one against the rest, averaged.

    Trees pass over the rows once a level, so these are shared out over all cores first.
    """
    from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if model not in ("random_forest", "gradient_boosting", "xgboost"):
        raise ValueError(f"unknown model {model!r}")
    cls = is_classification(df, label)
    d = assemble(even(df.select(*[F.col(q(c)) for c in dict.fromkeys([*features, label])])), features, label, cls)
    args = {"featuresCol": "v", "labelCol": "y", "seed": seed, "maxDepth": depth} | ({"subsamplingRate": sample} if sample < 1 else {})
    if model != "gradient_boosting":
        m = (RandomForestClassifier if cls else RandomForestRegressor)(numTrees=trees, **args).fit(d)
        v = m.featureImportances.toArray()
    elif not cls:
        v = GBTRegressor(maxIter=trees, **args).fit(d).featureImportances.toArray()
    elif d.select("y").distinct().count() <= 2:
        v = GBTClassifier(maxIter=trees, **args).fit(d).featureImportances.toArray()
    else:
        o = OneVsRest(classifier=GBTClassifier(maxIter=trees, **args), featuresCol="v", labelCol="y").fit(d)
        v = np.mean([m.featureImportances.toArray() for m in o.models], axis=0)
    return dict(zip(features, map(float, v)))


class FeatureSelector:
    """Scores by several methods, combination, redundancy, and the final cut."""

    def __init__(self, methods: tuple[str, ...] = ("mutual_info", "f_test", "correlation"), max_features: int | None = None, correlation_threshold: float = 0.95, combination: str = "union", original_features: list[str] | None = None, trees: int = 100, refine: bool = False) -> None:
        if unknown := set(methods) - set(METHODS):
            raise ValueError(f"unknown methods: {sorted(unknown)}")
        if combination not in ("union", "intersection"):
            raise ValueError("combination is union or intersection")
        self.methods, self.max_features, self.threshold, self.combination, self.trees, self.refine = methods, max_features, correlation_threshold, combination, trees, refine
        self.originals = original_features
        self.method_scores: dict[str, dict[str, float]] = {}
        self.scores: dict[str, float] = {}
        self.selected: list[str] = []

    def fit(self, df: DataFrame, label: str) -> "FeatureSelector":
        numeric = columns_of(df, FeatureType.NUMERIC, [label])
        cats = columns_of(df, FeatureType.CATEGORICAL, [label])
        originals = [c for c in (self.originals if self.originals is not None else [*numeric, *cats]) if c in df.columns]
        fns = {"mutual_info": mutual_information, "f_test": f_test, "chi2": chi2, "correlation": correlation}
        for m in self.methods:
            if not numeric:
                got = {}
            elif m == "importance":
                got = importances(df, numeric, label, trees=self.trees)
            else:
                got = {r["feature"]: float(r["score"]) for r in fns[m](df, numeric, label).collect()}
            self.method_scores[m] = got
        for f in numeric:
            shares = [s.get(f, 0.0) / top for s in self.method_scores.values() if (top := max(s.values(), default=0)) > 0]
            self.scores[f] = (min if self.combination == "intersection" else lambda v: sum(v) / len(v))(shares) if shares else 0.0
        positive = [v for v in self.scores.values() if v > 0]
        for c in cats:
            self.scores[c] = max(self.scores.get(c, 0.0), median(positive) if positive else 0.5)
        gone: set[str] = set()
        if self.threshold < 1 and len(numeric) > 1:
            gone = redundant(numeric, gram_correlation(df, numeric), self.scores, set(originals), self.threshold)
        kept = set(originals)
        base = [self.scores.get(c, 0.0) for c in originals]
        derived = sorted((f for f in self.scores if f not in kept and f not in gone), key=lambda f: (-self.scores[f], f))
        floor = 1.5 * median(base) if base and median(base) > 0 else 0.1 * max(self.scores.values(), default=0)
        derived = [f for f in derived if self.scores[f] >= floor][: max(int(1.5 * len(originals)), 10)]
        if self.max_features is not None:
            derived = derived[: max(0, self.max_features - len(originals))]
        if self.refine and len(derived) > 3:
            imp = importances(df, derived, label, "gradient_boosting", trees=50, depth=3, sample=0.8)
            mean = sum(imp.values()) / len(imp)
            derived = [f for f in derived if imp[f] >= mean] or sorted(derived, key=lambda f: -imp[f])[:3]
        chosen = kept | set(derived)
        self.selected = [c for c in df.columns if c in chosen]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(q(c)) for c in self.selected if c in df.columns])

    def set_selected_features(self, names: list[str]) -> None:
        """Fixes what ``transform`` keeps, in this order."""
        self.selected = list(names)

    @property
    def feature_importances(self) -> dict[str, float]:
        return dict(self.scores)

    def ranking(self) -> list[tuple[str, float]]:
        return sorted(self.scores.items(), key=lambda x: (-x[1], x[0]))


def top(scores: dict[str, float], threshold: float | None = None, k: int | None = None) -> list[str]:
    """Features by falling score, ties in the order given: those at or above the threshold, the first k of them."""
    ranked = sorted(scores, key=lambda f: -scores[f])
    return [f for f in ranked if threshold is None or scores[f] >= threshold][:k]


def encoded(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """(frame, columns) with what a model can take: strings as the place among their sorted values, -1 for null; booleans
    as 0 and 1; times as seconds.  Columns of nested types are left out.
    """
    kept = []
    for c in columns:
        kind = FeatureType.of(df.schema[c].dataType)
        if kind is None:
            continue
        if kind == FeatureType.CATEGORICAL:
            df = label_encode(df, c).drop(c).withColumnRenamed(f"{c}_encoded", c)
        elif kind == FeatureType.DATETIME:
            df = df.withColumn(c, F.unix_micros(F.col(q(c)).cast("timestamp")) / 1e6)
        elif kind == FeatureType.BOOLEAN:
            df = df.withColumn(c, F.col(q(c)).cast("int"))
        kept.append(c)
    return df, kept


def gate(df: DataFrame, originals: list[str], full: list[str], label: str, key: str, splits: int = 5, trees: int = 50, depth: int = 10, test_size: float = 0.2, seed: int = 42) -> tuple[bool, float]:
    """(keep derived?, mean gain) over held-out splits, stratified for classes; the bar rises with the share of derived features.

    Both sides of every split see the same rows.  If no model can be fitted the derived features are not kept.
    Forests pass over all rows once a level, so the rows are shared out over all cores, and keep their nodes from level to level.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    cls = is_classification(df, label)
    d, kept = encoded(df.where(F.col(q(label)).isNotNull()), [c for c in dict.fromkeys([*originals, *full]) if c in df.columns])
    base, both = [c for c in originals if c in kept], [c for c in full if c in kept]
    if not both:
        return False, 0.0
    base = base or both[:1]
    y = label_codes(d, label).select(F.col("v").alias("__v"), F.col("code").cast("double").alias("__y")) if cls else None
    d = d.join(y, F.col(q(label)).cast("string") == F.col("__v")) if cls else d.withColumn("__y", F.col(q(label)).cast("double"))
    vector = lambda cols: F.array(*[_x(c) for c in cols])
    d = stored(even(d.select(F.col(q(key)).alias("key"), F.col("__y").alias("y"), vector(base).alias("base"), vector(both).alias("both")), "key"))
    gains = []
    for s in range(splits):
        if cls:
            cut = stored(even(stratified(d, "y", "key", test_size, seed + s), "key"))
        else:
            cut = d.withColumn("is_test", (F.pmod(F.xxhash64("key", F.lit(seed + s)), F.lit(10_000)) < int(10_000 * test_size)).cast("int"))
        got = []
        for side in ("base", "both"):
            v = cut.select("y", "is_test", array_to_vector(side).alias("v"))
            rf = (RandomForestClassifier if cls else RandomForestRegressor)(featuresCol="v", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, checkpointInterval=-1)
            ev = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy") if cls else RegressionEvaluator(labelCol="y", metricName="r2")
            try:
                got.append(ev.evaluate(rf.fit(v.where("is_test = 0")).transform(v.where("is_test = 1"))))
            except Exception as e:  # noqa: BLE001 - whatever stops a model, the originals are safe
                warnings.warn(f"the gate could not fit a model: {str(e).splitlines()[0]}", UserWarning, stacklevel=2)
                return False, 0.0
        discard(cut)
        gains.append(got[1] - got[0])
    discard(d)
    gain = sum(gains) / len(gains)
    return gain >= 0.001 + 0.001 * max(0, len(full) - len(originals)) / max(1, len(originals)), gain
