"""Named example tables, made by Spark from a seed: the columns and the rule of the label of each are fixed, its rows and seed are given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Make = Callable[[int], tuple[dict[str, Column], Column]]


def _n(seed: int, k: int, mean: float = 0.0, sd: float = 1.0) -> Column:
    return F.randn(seed * 101 + k) * sd + mean


def _u(seed: int, k: int, lo: float, hi: float) -> Column:
    return F.rand(seed * 101 + k) * (hi - lo) + lo


def _normals(k: int, label: Callable[..., Column], classes: bool) -> Make:
    def make(seed: int):
        cols = {f"x{i}": _n(seed, i) for i in range(k)}
        y = label(*[F.col(f"x{i}") for i in range(k)]) + _n(seed, 90, 0, 0.2)
        return cols, (y > 0).cast("int") if classes else y

    return make


def _credit(seed: int):
    cols = {"age": F.floor(_u(seed, 0, 18, 75)), "income": F.exp(_n(seed, 1, 10.5, 0.6)), "debt": F.exp(_n(seed, 2, 9, 1)), "credit_history_months": F.floor(_u(seed, 3, 0, 360)), "num_loans": F.floor(_u(seed, 4, 0, 6)), "savings": F.exp(_n(seed, 5, 8, 1.2))}
    risk = F.col("debt") / (F.col("income") + 1) - F.col("savings") / (F.col("income") + 1) + F.col("num_loans") * 0.05 - F.col("credit_history_months") / 1000
    return cols, (risk + _n(seed, 90, 0, 0.1) > 0.2).cast("int")


def _churn(seed: int):
    cols = {"tenure_months": F.floor(_u(seed, 0, 1, 72)), "monthly_charges": _u(seed, 1, 20, 120), "support_tickets": F.floor(_u(seed, 2, 0, 9)), "usage_minutes": _u(seed, 3, 0, 2000), "plan_tier": F.element_at(F.array(*map(F.lit, ("basic", "plus", "max"))), (F.floor(_u(seed, 4, 0, 3)) + 1).cast("int"))}
    return cols, (F.col("support_tickets") / (F.col("tenure_months") + 1) * 10 + F.col("monthly_charges") / 60 + _n(seed, 90) > 3).cast("int")


def _house(seed: int):
    cols = {"area": _u(seed, 0, 40, 300), "rooms": F.floor(_u(seed, 1, 1, 8)), "age": F.floor(_u(seed, 2, 0, 90)), "distance": _u(seed, 3, 0, 30)}
    return cols, F.col("area") * 2000 + F.col("rooms") * 8000 - F.col("age") * 300 - F.col("distance") * 2500 + _n(seed, 90, 0, 8000)


def _sensor(seed: int):
    hour = F.pmod(F.col("id"), F.lit(24))
    cols = {"hour": hour, "day": F.floor(F.col("id") / 24), "temperature": 15 + 8 * F.sin(hour / 24 * 6.283185307179586) + _n(seed, 0), "load": 50 + 20 * F.cos(hour / 24 * 6.283185307179586) + _n(seed, 1, 0, 4)}
    return cols, F.col("load") * 0.8 + F.col("temperature") * 1.5 + _n(seed, 90)


def _reviews(seed: int):
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (F.floor(_u(seed, k, 0, len(xs))) + 1).cast("int"))
    good = F.rand(seed * 101 + 7) < 0.5
    word = F.when(good, pick(0, ("great", "excellent", "perfect", "nice"))).otherwise(pick(1, ("poor", "broken", "awful", "terrible")))
    cols = {"review_text": F.concat_ws(" ", F.lit("the product is"), word, F.lit("and the delivery was"), pick(2, ("fast", "slow", "late"))), "price": _u(seed, 3, 5, 500), "rating": F.when(good, 4).otherwise(2) + F.floor(_u(seed, 4, 0, 2)), "helpful_votes": F.floor(_u(seed, 5, 0, 40))}
    return cols, good.cast("int")


#: name: (category, task, default rows, columns and label)
DATASETS: dict[str, tuple[str, str, int, Make]] = {
    "complex_regression": ("synthetic", "regression", 2000, _normals(6, lambda a, b, c, d, e, f: a * b + c * c - d * e + F.sin(f), False)),
    "complex_classification": ("synthetic", "classification", 2000, _normals(6, lambda a, b, c, d, e, f: a * b + c * c - d * e - 1, True)),
    "polynomial_regression": ("synthetic", "regression", 2000, _normals(4, lambda a, b, c, d: a * a + b * b * b + c * d, False)),
    "xor_classification": ("synthetic", "classification", 2000, _normals(4, lambda a, b, c, d: a * b, True)),
    "pairwise_classification": ("synthetic", "classification", 2500, _normals(6, lambda a, b, c, d, e, f: a * b + c * d + e * f, True)),
    "triple_regression": ("synthetic", "regression", 2500, _normals(5, lambda a, b, c, d, e: a * b * c + d - e, False)),
    "credit_risk": ("business", "classification", 2000, _credit),
    "customer_churn": ("business", "classification", 2000, _churn),
    "house_prices": ("business", "regression", 1500, _house),
    "sensor_load": ("timeseries", "regression", 2000, _sensor),
    "product_reviews": ("text", "classification", 2000, _reviews),
}


def names(category: str | None = None) -> list[str]:
    known = sorted({c for c, *_ in DATASETS.values()})
    if category is not None and category not in known:
        raise ValueError(f"category is one of {known}")
    return sorted(n for n, (c, *_) in DATASETS.items() if category in (None, c))


def info(name: str) -> dict:
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name!r}; known: {names()}")
    category, task, rows, _ = DATASETS[name]
    return {"name": name, "category": category, "task": task, "rows": rows, "label": "target"}


def load(spark: SparkSession, name: str, rows: int | None = None, seed: int = 42) -> DataFrame:
    """(id, columns, target) of a data set; the same rows for the same seed, whatever the cluster."""
    n = rows or info(name)["rows"]
    cols, label = DATASETS[name][3](seed)
    base = spark.range(0, n, 1, 8)  # the seeds of random columns are per partition
    return base.withColumns(cols).withColumn("target", label)
