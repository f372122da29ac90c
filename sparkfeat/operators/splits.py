"""Train and test splits, folds, imputation, metrics and the paired significance test."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import num, q
from .order import ordered, sums_before


def _check(size: float) -> None:
    if not 0 < size < 1:
        raise ValueError("test_size must lie between 0 and 1")


def chronological(df: DataFrame, order: list[str], test_size: float = 0.2) -> DataFrame:
    """``df`` with ``is_test``: 1 for the last share of rows in time.

    Rows are ranked over range partitions; ties of all order columns may fall on either side.
    """
    _check(test_size)
    n = df.count()
    k = n - max(1, int(round(n * test_size)))
    if k < 1:
        raise ValueError("the training side is empty")
    return ordered(df, order, "__rank").select(*[F.col(q(c)) for c in df.columns], (F.col("__rank") > k).cast("int").alias("is_test"))


def stratified(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42, hashed: bool = True) -> DataFrame:
    """``df`` with ``is_test``: in each class the first share of rows by hash of the key, or by the key itself."""
    _check(test_size)
    sizes = df.groupBy(F.col(q(label)).alias("__class")).agg(F.count("*").alias("__n"))
    at = ordered(df, [*([F.xxhash64(key, F.lit(seed))] if hashed else []), key], "__rank", [label])
    at = at.join(F.broadcast(sizes), F.col(q(label)).eqNullSafe(F.col("__class")))
    return at.select(*[F.col(q(c)) for c in df.columns], (F.col("__rank") <= F.round(F.col("__n") * test_size)).cast("int").alias("is_test"))


def folds(df: DataFrame, key: str, k: int = 5, label: str | None = None) -> DataFrame:
    """``df`` with ``fold`` 0 to k-1: by the key's value, in each class in turn if ``label`` is given."""
    if label is None:
        return df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))
    at = ordered(df, [key], "__rank", [label])
    return at.select(*[F.col(q(c)) for c in df.columns], F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int").alias("fold"))


def time_folds(df: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """``df`` with ``block`` 0 to k: fold f trains on blocks up to f and tests on block f + 1, so no fold learns from its future.

    Blocks are runs of rows in time; the first takes what does not divide by k + 1.
    """
    n = df.count()
    size = n // (k + 1)
    if size < 1:
        raise ValueError("too few rows for so many folds")
    first = n - k * size
    block = F.greatest(F.lit(0), F.floor((F.col("__rank") - 1 - first) / size) + 1).cast("int")
    return ordered(df, order, "__rank").select(*[F.col(q(c)) for c in df.columns], block.alias("block"))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Medians of the training rows; 0.0 for a column without values."""
    r = df.agg(*[F.median(F.expr(num(c))).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    return {c: float(r[k]) if r[k] is not None else 0.0 for k, c in enumerate(columns)}


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    return df.select(*[F.coalesce(F.expr(num(c)), F.lit(fill[c])).alias(c) if c in fill else F.col(q(c)) for c in df.columns])


def align(test: DataFrame, train: DataFrame) -> DataFrame:
    """``test`` with the columns of ``train``: missing numbers 0, other missing columns "missing", more dropped."""
    out = []
    for f in train.schema.fields:
        if f.name in test.columns:
            out.append(F.col(q(f.name)))
        else:
            out.append((F.lit("missing") if f.dataType.typeName() == "string" else F.lit(0)).cast(f.dataType).alias(f.name))
    return test.select(*out)


def wilcoxon(a: list[float], b: list[float]) -> float:
    """Two-sided p of the signed-rank test, exact by enumeration up to 20 pairs; 1.0 for under 5 or no differences."""
    d = [x - y for x, y in zip(a, b) if x != y]
    if len(a) < 5 or not d:
        return 1.0
    size = sorted((abs(x), k) for k, x in enumerate(d))
    rank = [0.0] * len(d)
    i = 0
    while i < len(size):
        j = i
        while j + 1 < len(size) and size[j + 1][0] == size[i][0]:
            j += 1
        for m in range(i, j + 1):
            rank[size[m][1]] = (i + j) / 2 + 1
        i = j + 1
    w = sum(r for r, x in zip(rank, d) if x > 0)
    total = sum(rank)
    low = min(w, total - w)
    if len(d) <= 16:
        hits = sum(min(s := sum(r for r, e in zip(rank, signs) if e), total - s) <= low + 1e-12 for signs in product((0, 1), repeat=len(d)))
        return hits / 2 ** len(d)
    from math import erf, sqrt

    n = len(d)
    z = (low - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return min(1.0, 1 + erf(z / sqrt(2)))


def roc_auc(df: DataFrame, label: str, score: str) -> float | None:
    """Area under the ROC curve, exact with ties: the share of pairs of a positive and a negative that the score orders, half for equal ones.

    Rows are counted by distinct score; only these counts are ordered, over range partitions.  None without both classes.
    """
    by = df.select(F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s")).where("y is not null and s is not null")
    by = by.groupBy("s").agg(F.sum((F.col("y") > 0).cast("long")).alias("p"), F.sum((F.col("y") <= 0).cast("long")).alias("n"))
    r = sums_before(by, ["s"], "n", "lower").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2)).alias("won")).first()
    return r["won"] / (r["p"] * r["n"]) if r["p"] and r["n"] else None


def metrics(df: DataFrame, label: str, prediction: str, classification: bool, score: str | None = None) -> dict[str, float]:
    """Accuracy and F1, with ROC-AUC if ``score`` names the positive class's column; R2, RMSE and MAE of a regression."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

    d = df.select(F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction"))
    if classification:
        return {"accuracy": MulticlassClassificationEvaluator(metricName="accuracy").evaluate(d), "f1": MulticlassClassificationEvaluator(metricName="f1").evaluate(d)} | ({"roc_auc": roc_auc(df, label, score)} if score else {})
    return {m: RegressionEvaluator(metricName=m).evaluate(d) for m in ("r2", "rmse", "mae")}
