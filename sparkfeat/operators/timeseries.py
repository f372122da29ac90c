"""Series to scalar features.

A series is the non-null values of a column in the order of ``order_cols``, per entity or of the
whole table.  Features come from one aggregation over windows, or, for
entropies and the dominant frequency, from NumPy per entity.  Windows partition by the entity, so an entity's series
is ordered within one task; the series of a whole table is ordered by range partitions and cut into chunks that overlap.
Features that need no order never sort.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import num
from ..functions.stats import correlation as pearson
from .arrays import array_series as array_features
from .entropy import approximate_entropy, sample_entropy
from .order import ordered

__all__ = ["TimeSeriesEngine", "array_features", "approximate_entropy", "sample_entropy"]

GROUPS = ("basic_stats", "distribution", "autocorrelation", "peaks", "trends", "rolling", "fft", "entropy", "energy", "complexity", "counts")
DEFAULT = ("basic_stats", "distribution", "autocorrelation")
WINDOWS = (5, 10, 20)
#: Rows of a window of a series without entities.
CHUNK = 100_000


def _when(least: int, value: Column, n: Column | None = None) -> Column:
    return F.when((F.count("x") if n is None else n) >= least, value)


def _safe(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


class TimeSeriesEngine:
    """``fit`` fixes nothing but the columns; ``transform`` gives one row per entity.

    ``only`` names the features that are wanted (or beginnings of their names): dear ones that are not are left out.
    """

    def __init__(self, order_cols: list[str], entity_cols: list[str] | None = None, features: list[str] | None = None, window_sizes: tuple[int, ...] = WINDOWS, lags: int = 10, coefficients: int = 10, only: list[str] | None = None) -> None:
        if not order_cols:
            raise ValueError("a series needs order_cols")
        self.order, self.entity = list(order_cols), list(entity_cols or [])
        self.groups = [g for g in (DEFAULT if features is None else features) if g in GROUPS]
        self.windows, self.lags, self.coefficients, self.only = window_sizes, lags, coefficients, only

    def transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        out = None
        for c in columns:
            one = self._column(df, c)
            out = one if out is None else self._join(out, one)
        return out

    def _join(self, a: DataFrame, b: DataFrame) -> DataFrame:
        if not self.entity:
            return a.crossJoin(b)
        b = b.select(*[F.col(k).alias(f"__{k}") for k in self.entity], *[c for c in b.columns if c not in self.entity])
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.entity]
        return a.join(b, on, "full").select(*[F.coalesce(k, f"__{k}").alias(k) for k in self.entity], *[c for c in a.columns if c not in self.entity], *[c for c in b.columns if not c.startswith("__")])

    def broadcast_to(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Every row of ``df`` with its series' features."""
        made = self.transform(df, columns)
        if not self.entity:
            return df.crossJoin(F.broadcast(made))
        made = made.select(*[F.col(k).alias(f"__{k}") for k in self.entity], *[c for c in made.columns if c not in self.entity])
        return df.join(made, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.entity], "left").drop(*[f"__{k}" for k in self.entity])

    def _series(self, df: DataFrame, c: str) -> DataFrame:
        """(entity, i, x): the non-null values with their place from 0; of the whole table by range partitions."""
        base = df.select(*self.entity, *[F.col(o).alias(f"o{k}") for k, o in enumerate(self.order)], F.expr(num(c)).alias("x")).where("x is not null")
        order = [f"o{k}" for k in range(len(self.order))]
        if self.entity:
            return base.withColumn("i", F.row_number().over(Window.partitionBy(*self.entity).orderBy(*order)) - 1).drop(*order)
        return ordered(base, order, "r").select("x", (F.col("r") - 1).alias("i"))

    def _with(self, series: DataFrame, add: dict, before: int = 0, after: int = 0) -> DataFrame:
        """``series`` with columns made by windows in the order of ``i``, each a function of the window.

        With entities a window is an entity.  Without, it is a chunk of ``CHUNK`` rows with copies of the rows
        ``before`` and ``after`` it, enough for every lag, lead and frame used.
        """
        if self.entity:
            w = Window.partitionBy(*self.entity).orderBy("i")
            return series.withColumns({k: f(w) for k, f in add.items()})
        at, home = F.col("i") % CHUNK, F.floor(F.col("i") / CHUNK)
        to = F.array_compact(F.array(home, F.when(at >= CHUNK - before, home + 1), F.when((at < after) & (home > 0), home - 1)))
        w = Window.partitionBy("__chunk").orderBy("i")
        return series.withColumn("__home", home).withColumn("__chunk", F.explode(to)).withColumns({k: f(w) for k, f in add.items()}).where("__chunk = __home").drop("__chunk", "__home")

    def _facts(self, series: DataFrame) -> DataFrame:
        """``series`` with the number, mean, greatest and least of its values; by a window of the entity, or one row for all."""
        made = {"n": F.count("x"), "mu": F.avg("x"), "hi": F.max("x"), "lo": F.min("x")}
        if self.entity:
            return series.withColumns({k: v.over(Window.partitionBy(*self.entity)) for k, v in made.items()})
        return series.crossJoin(F.broadcast(series.agg(*[v.alias(k) for k, v in made.items()])))

    def _column(self, df: DataFrame, c: str) -> DataFrame:
        g, aggs = self.groups, []
        base = df.select(*self.entity, F.expr(num(c)).alias("x"))
        series, x = base, F.col("x")
        plain = not set(g) - {"basic_stats", "distribution"}
        if not plain:
            series = self._facts(self._series(df, c))
            add, before, after = {}, 0, 0
            if set(g) & {"trends", "energy", "complexity", "counts", "peaks"}:
                add |= {"p1": lambda w: F.lag("x", 1).over(w), "p2": lambda w: F.lag("x", 2).over(w)}
                before = 2
            if "autocorrelation" in g:
                add |= {f"lag{k}": lambda w, k=k: F.lag("x", k).over(w) for k in range(1, self.lags + 1)}
                before = max(before, self.lags)
            if "rolling" in g:
                for s in self.windows:
                    ok = F.col("i") >= s - 1
                    add |= {f"rm{s}": lambda w, s=s, ok=ok: F.when(ok, F.avg("x").over(w.rowsBetween(1 - s, 0))), f"rs{s}": lambda w, s=s, ok=ok: F.when(ok, F.stddev_samp("x").over(w.rowsBetween(1 - s, 0)))}
                    before = max(before, s - 1)
            if "peaks" in g:
                add["a1"] = lambda w: F.lead("x", 1).over(w)
                after = 1
            series = self._with(series, add, before, after) if add else series
            if "complexity" in g:
                series = self._same(series)
        def put(name: str, value: Column) -> None:
            if f"{c}_{name}" not in seen:
                seen.add(f"{c}_{name}")
                aggs.append(value.alias(f"{c}_{name}"))

        seen: set[str] = set()
        if "basic_stats" in g:
            mean, sd = F.avg(x), F.stddev_pop(x)
            for name, v in (("mean", mean), ("std", sd), ("min", F.min(x)), ("max", F.max(x)), ("range", F.max(x) - F.min(x)), ("median", F.median(x)), ("sum", F.coalesce(F.sum(x), F.lit(0.0))), ("var", F.var_pop(x)), ("cv", F.when(mean == 0, 0.0).otherwise(sd / F.abs(mean)))):
                put(name, v)
            if plain:
                put("length", F.count(F.lit(1)))
        if "distribution" in g:
            put("skewness", _when(4, F.skewness(x)))
            put("kurtosis", _when(4, F.kurtosis(x)))
            for p in (10, 25, 75, 90):
                put(f"q{p}", _when(4, F.percentile(x, p / 100)))
            put("iqr", _when(4, F.percentile(x, 0.75) - F.percentile(x, 0.25)))
        if "autocorrelation" in g:
            for k in range(1, self.lags + 1):
                put(f"autocorr_lag{k}", F.when((F.var_pop(x) != 0) & (F.count(x) > self.lags), pearson(x, f"lag{k}")))
        if "trends" in g:
            i = F.col("i").cast("double")
            put("trend_slope", _when(2, F.regr_slope(x, i)))
            put("trend_intercept", _when(2, F.regr_intercept(x, i)))
            first, last = F.min_by(x, "i"), F.max_by(x, "i")
            put("first_value", _when(2, first))
            put("last_value", _when(2, last))
            put("change", _when(2, last - first))
            put("mean_abs_change", F.avg(F.abs(x - F.col("p1"))))
            put("mean_change", F.avg(x - F.col("p1")))
        if "rolling" in g:
            for s in self.windows:
                put(f"rolling{s}_mean_of_means", F.avg(f"rm{s}"))
                put(f"rolling{s}_max_of_means", F.max(f"rm{s}"))
                put(f"rolling{s}_std_of_stds", F.stddev_samp(f"rs{s}"))
        if "fft" in g and self._wants(f"{c}_fft_coeff", f"{c}_spectral"):
            n = F.col("n")
            for k in range(1, self.coefficients + 1):
                turn = 2 * math.pi * k * F.col("i") / n
                size = F.sqrt(F.pow(F.sum(x * F.cos(turn)), 2) + F.pow(F.sum(x * F.sin(turn)), 2))
                put(f"fft_coeff_{k}", F.when((F.max("n") >= 4) & (F.floor(F.max("n") / 2) >= k), size))
            put("spectral_energy", _when(4, F.count(x) * F.sum(x * x)))
        if "energy" in g:
            put("abs_energy", _when(2, F.sum(x * x)))
            put("mean_abs_change", F.avg(F.abs(x - F.col("p1"))))
            put("mean_second_deriv_central", F.avg(x - 2 * F.col("p1") + F.col("p2")))
            rms = F.sqrt(F.avg(x * x))
            put("rms", _when(2, rms))
            put("crest_factor", F.when((F.count(x) >= 2) & (rms > 0), F.max(F.abs(x)) / rms))
        if "complexity" in g:
            d = x - F.col("p1")
            put("cid_ce", _when(3, F.sqrt(F.sum(d * d))))
            put("c3", F.avg(x * F.col("p1") * F.col("p2")))
            put("ratio_unique_values", _when(3, F.count_distinct(x) / F.count(x)))
            put("has_duplicate", _when(3, (F.count_distinct(x) < F.count(x)).cast("int")))
            put("has_duplicate_max", _when(3, (F.max(F.when(x == F.col("hi"), F.col("same"))) > 1).cast("int")))
            put("has_duplicate_min", _when(3, (F.max(F.when(x == F.col("lo"), F.col("same"))) > 1).cast("int")))
            again = F.col("same") > 1
            put("sum_reoccurring_values", _when(3, F.coalesce(F.sum(F.when(again, x)), F.lit(0.0))))
            put("sum_reoccurring_data_points", _when(3, F.sum(again.cast("int"))))
            put("pct_reoccurring_data_points", _when(3, F.sum(again.cast("int")) / F.count(x)))
        if "counts" in g:
            mu, i, n = F.col("mu"), F.col("i"), F.count(x)
            put("count_above_mean", _when(2, F.sum((x > mu).cast("int"))))
            put("count_below_mean", _when(2, F.sum((x < mu).cast("int"))))
            put("first_loc_max", _when(2, F.min(F.when(x == F.col("hi"), i)) / n))
            put("first_loc_min", _when(2, F.min(F.when(x == F.col("lo"), i)) / n))
            put("last_loc_max", _when(2, F.max(F.when(x == F.col("hi"), i)) / n))
            put("last_loc_min", _when(2, F.max(F.when(x == F.col("lo"), i)) / n))
            put("number_crossings_mean", _when(2, F.coalesce(F.sum((F.signum(x - mu) != F.signum(F.col("p1") - mu)).cast("int")), F.lit(0))))
            put("number_zero_crossings", _when(2, F.coalesce(F.sum((F.signum(x) != F.signum("p1")).cast("int")), F.lit(0))))
            put("abs_sum_changes", _when(2, F.sum(F.abs(x - F.col("p1")))))
        if not plain and self.entity:
            series = self._runs(series, put, g)
        out = self._by(series).agg(*aggs) if aggs else None
        more = []
        if "basic_stats" in g and not plain:
            more.append(self._by(base).agg(F.count(F.lit(1)).alias(f"{c}_length")))
        if not self.entity:
            more += self._runs_of_all(series, c, g)
        if "entropy" in g and self._wants(f"{c}_binned"):
            more.append(self._binned_entropy(series, c))
        if "entropy" in g and self._wants(f"{c}_sample", f"{c}_approximate"):
            more.append(self._entropies(series, c))
        if "fft" in g and self._wants(f"{c}_dominant"):
            more.append(self._dominant(series, c))
        for m in more:
            out = m if out is None else self._join(out, m)
        return out

    def _by(self, df: DataFrame):
        return df.groupBy(*self.entity) if self.entity else df.groupBy()

    def _wants(self, *starts: str) -> bool:
        """Whether a name that begins so is asked for; all are unless ``only`` is given."""
        return self.only is None or any(o.startswith(s) or s.startswith(o) for o in self.only for s in starts)

    def _same(self, series: DataFrame) -> DataFrame:
        """How often each value occurs in its series: counted and joined back, so that a frequent value is no task of its own."""
        by = series.groupBy(*self.entity, "x").agg(F.count("*").alias("same")).select(*[F.col(k).alias(f"__{k}") for k in self.entity], F.col("x").alias("__x"), "same")
        on = F.col("x") == F.col("__x")
        for k in self.entity:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return series.join(by, on).drop("__x", *[f"__{k}" for k in self.entity])

    def _runs(self, series: DataFrame, put, g: list[str]) -> DataFrame:
        """Local extrema and longest strikes from the series' own windows: what a run began with is carried to its end."""
        w = Window.partitionBy(*self.entity).orderBy("i")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        x, ok = F.col("x"), F.max("n")
        if "peaks" in g:
            before = F.last(F.when(F.col("p1") != x, F.col("p1")), ignorenulls=True).over(upto)
            series = series.withColumn("b1", before)
            ends = F.col("a1") != x  # the last row of a run of equal values that another follows
            peak, trough = ends & (x > F.col("b1")) & (x > F.col("a1")), ends & (x < F.col("b1")) & (x < F.col("a1"))
            at = lambda cond: F.when(cond, x)
            put("n_peaks", F.when(ok >= 3, F.count(at(peak))))
            put("n_troughs", F.when(ok >= 3, F.count(at(trough))))
            for name, v in (("peak_mean", F.avg(at(peak))), ("peak_max", F.max(at(peak))), ("trough_mean", F.avg(at(trough))), ("trough_min", F.min(at(trough)))):
                put(name, v)
        if "counts" in g:
            sign, last = F.signum(x - F.col("mu")), F.signum(F.col("p1") - F.col("mu"))
            begun = F.max(F.when(last.isNull() | (sign != last), F.col("i"))).over(upto)
            series = series.withColumns({"sign": sign, "run": F.col("i") - begun + 1})
            for name, v in (("above", 1.0), ("below", -1.0)):
                put(f"longest_strike_{name}_mean", F.when(ok >= 2, F.coalesce(F.max(F.when(F.col("sign") == v, F.col("run"))), F.lit(0))))
        return series

    def _runs_of_all(self, series: DataFrame, c: str, g: list[str]) -> list[DataFrame]:
        """The same of a whole table's series: only the rows where a run begins are ranked, and meet their neighbours."""
        out, x = [], F.col("x")
        if "peaks" in g:
            runs = ordered(series.where("p1 is null or p1 <> x").select(F.col("i").alias("j"), "x", "n"), ["j"], "r").select("x", "n", (F.col("r") - 1).alias("i"))
            runs = self._with(runs, {"b": lambda w: F.lag("x").over(w), "a": lambda w: F.lead("x").over(w)}, 1, 1)
            at = lambda sign: F.when((F.signum(x - F.col("b")) == sign) & (F.signum(x - F.col("a")) == sign), x)
            ok = F.max("n") >= 3
            out.append(runs.agg(F.when(ok, F.count(at(1))).alias(f"{c}_n_peaks"), F.when(ok, F.count(at(-1))).alias(f"{c}_n_troughs"), F.avg(at(1)).alias(f"{c}_peak_mean"), F.max(at(1)).alias(f"{c}_peak_max"), F.avg(at(-1)).alias(f"{c}_trough_mean"), F.min(at(-1)).alias(f"{c}_trough_min")))
        if "counts" in g:
            s = series.select("i", "n", F.signum(x - F.col("mu")).alias("sign"), F.signum(F.col("p1") - F.col("mu")).alias("last")).where("last is null or last <> sign")
            s = ordered(s.select(F.col("i").alias("j"), "n", "sign"), ["j"], "r").select("j", "n", "sign", (F.col("r") - 1).alias("i"))
            s = self._with(s, {"to": lambda w: F.lead("j").over(w)}, 0, 1).withColumn("len", F.coalesce("to", "n") - F.col("j"))
            longest = lambda v: F.when(F.max("n") >= 2, F.coalesce(F.max(F.when(F.col("sign") == v, F.col("len"))), F.lit(0)))
            out.append(s.agg(longest(1.0).alias(f"{c}_longest_strike_above_mean"), longest(-1.0).alias(f"{c}_longest_strike_below_mean")))
        return out

    def _binned_entropy(self, series: DataFrame, c: str, bins: int = 10) -> DataFrame:
        flat = F.col("hi") == F.col("lo")
        lo, width = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(flat, 1.0).otherwise(F.col("hi") - F.col("lo"))
        b = series.withColumn("bin", F.least(F.floor((F.col("x") - lo) / width * bins), F.lit(bins - 1)))
        b = b.groupBy(*self.entity, "bin").agg(F.count("*").alias("k"), F.max("n").alias("n"))
        p = F.col("k") / F.col("n")
        return self._by(b).agg(F.when(F.max("n") >= 4, -F.sum(p * F.log(p + 1e-10))).alias(f"{c}_binned_entropy"))

    def _per_entity(self, series: DataFrame, names: list[str], fn) -> DataFrame:
        keys = self.entity
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*keys).schema.fields] + [f"`{n}` double" for n in names])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            v = pdf.sort_values("i")["x"].to_numpy(dtype=float)
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{n: [r] for n, r in zip(names, fn(v))}})

        return self._by(series.select(*keys, "i", "x")).applyInPandas(run, schema)

    def _entropies(self, series: DataFrame, c: str) -> DataFrame:
        return self._per_entity(series, [f"{c}_sample_entropy", f"{c}_approximate_entropy"], lambda v: (sample_entropy(v), approximate_entropy(v)) if len(v) >= 4 else (None, None))

    def _dominant(self, series: DataFrame, c: str) -> DataFrame:
        def fn(v: np.ndarray):
            return (float(np.argmax(np.abs(np.fft.fft(v))[1 : len(v) // 2]) + 1),) if len(v) >= 4 else (None,)

        return self._per_entity(series, [f"{c}_dominant_freq_idx"], fn)
