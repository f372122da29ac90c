"""Registered queries, one for each family of operators, with their DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.compiler import compile_code
from .functions.expr import TRANSFORMS, q
from .leakage import leakage_columns
from .operators import scores, splits, text, timeseries
from .operators.relational import RelationalEngine, group_statistics
from .operators.tabular import TabularEngine, label_encode
from .plans.pipeline import AutoFeatureEngineer
from .rules import TransformRule
from .semantic import SemanticEngine, standardise
from .sources.shared import spread
from .sources.store import as_of, latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tt(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The same for costly work on each row, over all cores."""
    return spread(t(spark, d, name))


def rounded(df: DataFrame, digits: int = 6, without: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(F.col(q(c)), digits).alias(c) if k == "double" and c not in without else F.col(q(c)) for c, k in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]
KEYSQL = "l_orderkey, l_linenumber"


def _tab(spark: SparkSession, d: str, kinds: set[str], **how) -> DataFrame:
    df = t(spark, d, "lineitem").select(*KEYS, *LI)
    e = TabularEngine(**how).fit(df.select(*LI))
    out = e.transform(df)
    return out.select(*KEYS, *[f.name for f in e.features if f.transformation in kinds])


@query("tab_powers", f"SELECT {KEYSQL}, " + ", ".join(f"{c}*{c} AS {c}_pow2, {c}*{c}*{c} AS {c}_pow3" for c in LI) + " FROM lineitem")
def tab_powers(spark, d):
    return _tab(spark, d, {"power 2", "power 3"}, polynomial_degree=3)


@query("tab_products", f"SELECT {KEYSQL}, " + ", ".join(f"{a}*{b} AS {a}_x_{b}" for a, b in combinations(LI, 2)) + " FROM lineitem")
def tab_products(spark, d):
    return _tab(spark, d, {"product"})


@query("tab_ratios", f"SELECT {KEYSQL}, " + ", ".join(f"{a}/({b}+1e-8::DOUBLE) AS {a}_div_{b}" for a, b in combinations(LI, 2)) + " FROM lineitem")
def tab_ratios(spark, d):
    return _tab(spark, d, {"ratio"})


@query("tab_differences", f"SELECT {KEYSQL}, " + ", ".join(f"{a}-{b} AS {a}_minus_{b}" for a, b in combinations(LI, 2)) + " FROM lineitem")
def tab_differences(spark, d):
    return _tab(spark, d, {"difference"})


_DUCK = {"log": "ln(1+abs({x}))", "log10": "log10(abs({x})+1)", "sqrt": "sqrt(abs({x}))", "square": "{x}*{x}", "cube": "{x}*{x}*{x}", "reciprocal": "1/({x}+1e-8::DOUBLE)", "exp": "exp(least(greatest({x},-50),50))", "tanh": "tanh({x})", "sin": "sin({x})", "cos": "cos({x})", "abs": "abs({x})", "sign": "sign({x})::DOUBLE"}


def _tx(c: str, name: str, spark_side: bool):
    """Transcendental functions differ in their last bits between libraries and are rounded; the others are exact."""
    out, scale = f"{c}_{TRANSFORMS[name][0]}", 1e21 if name == "exp" else 1
    inexact = name in ("log", "log10", "exp", "tanh", "sin", "cos")
    if spark_side:
        return F.round(F.col(out) / scale, 9).alias(out) if inexact else F.col(out)
    sql = f"({_DUCK[name].format(x=c)}){'/1e21::DOUBLE' if name == 'exp' else ''}"
    return f"round({sql}, 9) AS {out}" if inexact else f"{sql} AS {out}"


@query("tab_transforms_all", "SELECT c_custkey, " + ", ".join(_tx("c_acctbal", n, False) for n in TRANSFORMS) + " FROM customer")
def tab_transforms_all(spark, d):
    df = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    e = TabularEngine(interaction_only=True, include_transforms=list(TRANSFORMS)).fit(df.select("c_acctbal"))
    return e.transform(df).select("c_custkey", *[_tx("c_acctbal", n, True) for n in TRANSFORMS])


@query("tab_capped_plan", "SELECT p_partkey, p_size::DOUBLE*p_size AS p_size_pow2, p_retailprice*p_retailprice AS p_retailprice_pow2, p_size*p_retailprice AS p_size_x_p_retailprice FROM part")
def tab_capped_plan(spark, d):
    df = t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    e = TabularEngine(max_features=3).fit(df.select("p_size", "p_retailprice"))
    return e.transform(df).drop("p_size", "p_retailprice")


@query("cat_onehot_other")
def cat_onehot_other(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    e = TabularEngine(keep_original_categorical=False).fit(df.select("o_orderstatus", "o_orderpriority"))
    out = e.transform(df)
    names = sorted(c for c in out.columns if c != "o_orderkey")
    return out.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(q(n)).alias("value")) for n in names])).alias("f")).select("o_orderkey", "f.feature", "f.value")


SQL["cat_onehot_other"] = """
WITH v AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS val FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
cats AS (SELECT col, val FROM v WHERE val IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT o_orderkey, 'o_orderstatus' AS col, o_orderstatus AS val FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders)
SELECT o_orderkey, r.col || '_' || cats.val AS feature, coalesce((r.val = cats.val)::INT, 0) AS value FROM r JOIN cats ON cats.col = r.col
UNION ALL SELECT o_orderkey, r.col || '_other', coalesce((NOT EXISTS (SELECT 1 FROM cats WHERE cats.col = r.col AND cats.val = r.val))::INT, 1) FROM r"""


@query("cat_target_encode", "WITH m AS (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1 HAVING count(*) >= 3) SELECT p_partkey, round(coalesce(m, (SELECT avg(p_retailprice) FROM part)), 6) AS p_brand_target_encoded FROM part LEFT JOIN m USING (p_brand)")
def cat_target_encode(spark, d):
    df = t(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    e = TabularEngine(one_hot_ratio=0.0, include_transforms=[], interaction_only=True).fit(df.select("p_brand", "p_retailprice"), "p_retailprice")
    return rounded(e.transform(df).select("p_partkey", "p_brand_target_encoded"))


@query("cat_label_encode", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS c_mktsegment_encoded FROM customer")
def cat_label_encode(spark, d):
    return label_encode(t(spark, d, "customer"), "c_mktsegment").select("c_custkey", "c_mktsegment_encoded")


@query("leakage_columns", "SELECT * FROM (VALUES ('my_target'), ('FutureSales'), ('price_label'), ('o_total')) v(name)")
def leakage(spark, d):
    names = leakage_columns(["age", "my_target", "FutureSales", "price_label", "o_total", "width", "__"], "o_totalprice")
    return spark.createDataFrame([(n,) for n in names], "name string")


def _aggs(c: str, parent: str) -> str:
    return f"round(avg({c}),6) AS {parent}_{c}_mean, round(sum({c}),4) AS {parent}_{c}_sum, count({c}) AS {parent}_{c}_count, max({c}) AS {parent}_{c}_max, min({c}) AS {parent}_{c}_min"


def _rounded_aggs(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4 if c.endswith("_sum") else 6).alias(c) if k == "double" and not c.endswith(("_max", "_min")) else F.col(c) for c, k in df.dtypes])


@query("rel_customer_order_aggs", f"WITH a AS (SELECT o_custkey, {_aggs('o_totalprice', 'orders')} FROM orders GROUP BY 1) SELECT c_custkey, a.* EXCLUDE (o_custkey) FROM customer LEFT JOIN a ON o_custkey = c_custkey")
def rel_customer_order_aggs(spark, d):
    e = RelationalEngine(max_categorical=0).add_relationship("orders", "c_custkey", "o_custkey")
    return _rounded_aggs(e.fit_transform(t(spark, d, "customer").select("c_custkey"), {"orders": t(spark, d, "orders").select("o_custkey", "o_totalprice")}))


@query("rel_order_lineitem_aggs", f"WITH a AS (SELECT l_orderkey, {_aggs('l_quantity', 'lineitem')}, {_aggs('l_extendedprice', 'lineitem')} FROM lineitem GROUP BY 1) SELECT o_orderkey, a.* EXCLUDE (l_orderkey) FROM orders LEFT JOIN a ON l_orderkey = o_orderkey")
def rel_order_lineitem_aggs(spark, d):
    e = RelationalEngine(max_categorical=0).add_relationship("lineitem", "o_orderkey", "l_orderkey")
    return _rounded_aggs(e.fit_transform(t(spark, d, "orders").select("o_orderkey"), {"lineitem": t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")}))


@query("rel_multi_relationship", "WITH c AS (SELECT c_custkey, c_acctbal FROM customer), a AS (SELECT l_orderkey, round(avg(l_discount),6) AS lineitem_l_discount_mean, stddev_samp(l_discount) AS s FROM lineitem GROUP BY 1) SELECT o_orderkey, c_acctbal AS customer_c_acctbal_mean, NULL::DOUBLE AS customer_c_acctbal_std, lineitem_l_discount_mean, round(s, 6) AS lineitem_l_discount_std FROM orders LEFT JOIN c ON c_custkey = o_custkey LEFT JOIN a ON l_orderkey = o_orderkey")
def rel_multi_relationship(spark, d):
    e = RelationalEngine(["mean", "std"], max_categorical=0).add_relationship("customer", "o_custkey", "c_custkey").add_relationship("lineitem", "o_orderkey", "l_orderkey")
    out = e.fit_transform(t(spark, d, "orders").select("o_orderkey", "o_custkey"), {"customer": t(spark, d, "customer").select("c_custkey", "c_acctbal"), "lineitem": t(spark, d, "lineitem").select("l_orderkey", "l_discount")})
    return rounded(out.drop("o_custkey"))


@query("rel_median_nunique", "WITH a AS (SELECT l_orderkey, median(l_quantity) AS lineitem_l_quantity_median, count(DISTINCT l_quantity) AS lineitem_l_quantity_nunique FROM lineitem GROUP BY 1) SELECT o_orderkey, a.* EXCLUDE (l_orderkey) FROM orders LEFT JOIN a ON l_orderkey = o_orderkey")
def rel_median_nunique(spark, d):
    e = RelationalEngine(["median", "nunique"], max_categorical=0).add_relationship("lineitem", "o_orderkey", "l_orderkey")
    return e.fit_transform(t(spark, d, "orders").select("o_orderkey"), {"lineitem": t(spark, d, "lineitem").select("l_orderkey", "l_quantity")})


@query("rel_first_last", "WITH a AS (SELECT user_id, arg_min(value, (ts, event_id)) AS events_value_first, arg_max(value, (ts, event_id)) AS events_value_last FROM events GROUP BY 1) SELECT u.user_id, events_value_first, events_value_last FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN a USING (user_id)")
def rel_first_last(spark, d):
    ev = t(spark, d, "events").select("user_id", "ts", "event_id", "value")
    e = RelationalEngine(["first", "last"], max_categorical=0).add_relationship("events", "user_id", "user_id", ("ts", "event_id"))
    return e.fit_transform(ev.select("user_id").distinct(), {"events": ev}).select("user_id", "events_value_first", "events_value_last")


@query("self_group_mean_count", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 6) AS o_totalprice_by_o_orderstatus_mean, count(o_totalprice) OVER (PARTITION BY o_orderstatus) AS o_totalprice_by_o_orderstatus_count FROM orders")
def self_group_mean_count(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rounded(group_statistics(df, ["o_orderstatus"], ["o_totalprice"]).drop("o_orderstatus", "o_totalprice"))


def _ts(spark: SparkSession, d: str, group: str, digits: int | None = 6, only: list[str] | None = None) -> DataFrame:
    out = timeseries.TimeSeriesEngine(["ts", "event_id"], ["user_id"], [group], only=only).transform(t(spark, d, "events"), ["value"])
    return out if digits is None else rounded(out, digits)


_BASE = """WITH s AS (SELECT user_id, value AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
lag(value) OVER w AS p1, lag(value, 2) OVER w AS p2, avg(value) OVER (PARTITION BY user_id) AS mu, max(value) OVER (PARTITION BY user_id) AS hi,
min(value) OVER (PARTITION BY user_id) AS lo, count(*) OVER (PARTITION BY user_id, value) AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
"""


def _ts_sql(parts: dict[str, str], base: str = _BASE, tail: str = "s GROUP BY user_id") -> str:
    return base + "SELECT user_id, " + ", ".join(e if e.startswith("#") else f"{e} AS value_{k}" for k, e in parts.items()).replace("#", "") + f" FROM {tail}"


def _r(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits})"


@query("ts_basic_stats", _ts_sql({"mean": _r("avg(x)"), "std": _r("stddev_pop(x)"), "min": _r("min(x)"), "max": _r("max(x)"), "range": _r("max(x)-min(x)"), "median": _r("median(x)"), "sum": _r("sum(x)"), "var": _r("var_pop(x)"), "cv": _r("CASE WHEN avg(x)=0 THEN 0 ELSE stddev_pop(x)/abs(avg(x)) END"), "length": "count(*)"}))
def ts_basic(spark, d):
    # partial sums in another order move a variance that lies half-way by its last bits: those are rounded away first
    return rounded(rounded(_ts(spark, d, "basic_stats", None), 11))


_M = lambda k: f"avg(power(x-mu,{k}))"


@query("ts_distribution", _ts_sql({"skewness": f"CASE WHEN count(x)>=4 THEN {_r(_M(3) + '/power(' + _M(2) + ',1.5)')} END", "kurtosis": f"CASE WHEN count(x)>=4 THEN {_r(_M(4) + '/power(' + _M(2) + ',2)-3')} END", **{f"q{p}": f"CASE WHEN count(x)>=4 THEN {_r(f'quantile_cont(x,{p / 100})')} END" for p in (10, 25, 75, 90)}, "iqr": f"CASE WHEN count(x)>=4 THEN {_r('quantile_cont(x,0.75)-quantile_cont(x,0.25)')} END"}))
def ts_distribution(spark, d):
    return _ts(spark, d, "distribution")


@query("ts_autocorr", "WITH s AS (SELECT user_id, value AS x, " + ", ".join(f"lag(value,{k}) OVER w AS l{k}" for k in range(1, 11)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, " + ", ".join(f"CASE WHEN var_pop(x)<>0 AND count(x)>10 THEN round(CASE WHEN isnan(corr(x,l{k})) THEN NULL ELSE corr(x,l{k}) END,6) END AS value_autocorr_lag{k}" for k in range(1, 11)) + " FROM s GROUP BY 1")
def ts_autocorr(spark, d):
    return _ts(spark, d, "autocorrelation")


@query("ts_peaks", """WITH s AS (SELECT user_id, value AS x, ts, event_id, lag(value) OVER w AS b, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, x, n, lag(x) OVER w AS b, lead(x) OVER w AS a FROM s WHERE b IS NULL OR b <> x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CASE WHEN max(n)>=3 THEN count(*) FILTER (x>b AND x>a) END AS value_n_peaks, CASE WHEN max(n)>=3 THEN count(*) FILTER (x<b AND x<a) END AS value_n_troughs,
round(avg(x) FILTER (x>b AND x>a),6) AS value_peak_mean, round(max(x) FILTER (x>b AND x>a),6) AS value_peak_max, round(avg(x) FILTER (x<b AND x<a),6) AS value_trough_mean, round(min(x) FILTER (x<b AND x<a),6) AS value_trough_min FROM r GROUP BY 1""")
def ts_peaks(spark, d):
    return _ts(spark, d, "peaks")


_2 = lambda e: f"CASE WHEN count(x)>=2 THEN {e} END"
_3 = lambda e: f"CASE WHEN count(x)>=3 THEN {e} END"


@query("ts_trends", _ts_sql({"trend_slope": _2(_r("regr_slope(x,i)")), "trend_intercept": _2(_r("regr_intercept(x,i)")), "first_value": _2(_r("arg_min(x,i)")), "last_value": _2(_r("arg_max(x,i)")), "change": _2(_r("arg_max(x,i)-arg_min(x,i)")), "mean_abs_change": _r("avg(abs(x-p1))"), "mean_change": _r("avg(x-p1)")}))
def ts_trends(spark, d):
    return _ts(spark, d, "trends")


@query("ts_rolling", "WITH s AS (SELECT user_id, row_number() OVER w AS rn, " + ", ".join(f"avg(value) OVER (PARTITION BY user_id ORDER BY ts,event_id ROWS {k - 1} PRECEDING) AS m{k}, stddev_samp(value) OVER (PARTITION BY user_id ORDER BY ts,event_id ROWS {k - 1} PRECEDING) AS d{k}" for k in (5, 10, 20)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, " + ", ".join(f"round(avg(m{k}) FILTER (rn>={k}),6) AS value_rolling{k}_mean_of_means, round(max(m{k}) FILTER (rn>={k}),6) AS value_rolling{k}_max_of_means, round(stddev_samp(d{k}) FILTER (rn>={k}),6) AS value_rolling{k}_std_of_stds" for k in (5, 10, 20)) + " FROM s GROUP BY 1")
def ts_rolling(spark, d):
    return _ts(spark, d, "rolling")


_AMP = lambda k: f"sqrt(power(sum(x*cos({2 * math.pi * k!r}*i/n)),2)+power(sum(x*sin({2 * math.pi * k!r}*i/n)),2))"


@query("ts_fft", _ts_sql({**{f"fft_coeff_{k}": f"CASE WHEN max(n)>=4 AND max(n)//2>={k} THEN {_r(_AMP(k), 4)} END" for k in range(1, 11)}, "spectral_energy": "CASE WHEN count(x)>=4 THEN round(count(x)*sum(x*x),2) END"}))
def ts_fft(spark, d):
    out = _ts(spark, d, "fft", None, ["value_fft_coeff", "value_spectral_energy"])
    return out.select("user_id", *[F.round(c, 2 if c.endswith("energy") else 4).alias(c) for c in out.columns if c != "user_id"])


@query("ts_dominant_freq")
def ts_dominant_freq(spark, d):
    return _ts(spark, d, "fft", 6, ["value_dominant_freq_idx"])


@query("ts_energy", _ts_sql({"abs_energy": _2(_r("sum(x*x)", 4)), "mean_abs_change": _r("avg(abs(x-p1))", 5), "mean_second_deriv_central": _r("avg(x-2*p1+p2)", 5), "rms": _2(_r("sqrt(avg(x*x))", 5)), "crest_factor": "CASE WHEN count(x)>=2 AND sqrt(avg(x*x))>0 THEN round(max(abs(x))/sqrt(avg(x*x)),4) END"}))
def ts_energy(spark, d):
    out = _ts(spark, d, "energy", None)
    return out.select("user_id", *[F.round(c, 4 if c.endswith(("energy", "factor")) else 5).alias(c) for c in out.columns if c != "user_id"])


@query("ts_complexity", _ts_sql({"cid_ce": _3(_r("sqrt(sum((x-p1)*(x-p1)))", 4)), "c3": _r("avg(x*p1*p2)", 2), "ratio_unique_values": _3(_r("count(DISTINCT x)/count(x)", 4)), "has_duplicate": _3("(count(DISTINCT x)<count(x))::INT"), "has_duplicate_max": _3("(max(same) FILTER (x=hi)>1)::INT"), "has_duplicate_min": _3("(max(same) FILTER (x=lo)>1)::INT"), "sum_reoccurring_values": _3(_r("coalesce(sum(x) FILTER (same>1),0)", 4)), "sum_reoccurring_data_points": _3("(count(*) FILTER (same>1))::BIGINT"), "pct_reoccurring_data_points": _3(_r("(count(*) FILTER (same>1))/count(x)", 4))}))
def ts_complexity(spark, d):
    out = _ts(spark, d, "complexity", None)
    return out.select(*[F.round(c, 2 if c == "value_c3" else 4).alias(c) if k == "double" else c for c, k in out.dtypes])


@query("ts_counts", _BASE.rstrip() + """, g AS (SELECT *, sign(x-mu) AS sg FROM s), isl AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, sg ORDER BY i) AS isle FROM g),
runs AS (SELECT user_id, sg, isle, count(*) AS len FROM isl GROUP BY ALL), best AS (SELECT user_id, coalesce(max(len) FILTER (sg=1),0) AS up, coalesce(max(len) FILTER (sg=-1),0) AS down FROM runs GROUP BY 1),
a AS (SELECT user_id, count(*) AS n, count(*) FILTER (x>mu) AS ca, count(*) FILTER (x<mu) AS cb, min(i) FILTER (x=hi) AS fh, min(i) FILTER (x=lo) AS fl, max(i) FILTER (x=hi) AS lh, max(i) FILTER (x=lo) AS ll,
count(*) FILTER (sign(x-mu)<>sign(p1-mu)) AS cm, count(*) FILTER (sign(x)<>sign(p1)) AS cz, sum(abs(x-p1)) AS ch FROM s GROUP BY 1)
SELECT user_id, ca AS value_count_above_mean, cb AS value_count_below_mean, round(fh/n,6) AS value_first_loc_max, round(fl/n,6) AS value_first_loc_min, round(lh/n,6) AS value_last_loc_max, round(ll/n,6) AS value_last_loc_min,
cm AS value_number_crossings_mean, cz AS value_number_zero_crossings, round(ch,6) AS value_abs_sum_changes, up AS value_longest_strike_above_mean, down AS value_longest_strike_below_mean FROM a JOIN best USING (user_id) WHERE n>=2""")
def ts_counts(spark, d):
    return _ts(spark, d, "counts").where("value_count_above_mean is not null")


@query("ts_binned_entropy", _BASE.rstrip() + """, b AS (SELECT user_id, n, CASE WHEN hi=lo THEN least(floor((x-lo+0.5)*10),9) ELSE least(floor((x-lo)/(hi-lo)*10),9) END AS bin FROM s),
k AS (SELECT user_id, bin, count(*) AS k, max(n) AS n FROM b GROUP BY ALL) SELECT user_id, CASE WHEN max(n)>=4 THEN round(-sum(k/n*ln(k/n+1e-10)),6) END AS value_binned_entropy FROM k GROUP BY 1""")
def ts_binned_entropy(spark, d):
    return _ts(spark, d, "entropy", 6, ["value_binned_entropy"])


@query("ts_entropy_pairs")
def ts_entropy_pairs(spark, d):
    return _ts(spark, d, "entropy", 6, ["value_sample_entropy", "value_approximate_entropy"])


@query("ts_array_rows", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1) AS i FROM embeddings), g AS (SELECT *, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM e) SELECT vec_id, round(avg(x),5) AS embedding_mean, round(stddev_pop(x),5) AS embedding_std, round(min(x),5) AS embedding_min, round(max(x),5) AS embedding_max, round(median(x),5) AS embedding_median, round(sum(x*x),5) AS embedding_abs_energy, round(avg(abs(x-p)),5) AS embedding_mean_abs_change FROM g GROUP BY 1")
def ts_array_rows(spark, d):
    out = timeseries.array_features(t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return rounded(out.select("vec_id", *[f"embedding_{k}" for k in ("mean", "std", "min", "max", "median", "abs_energy", "mean_abs_change")]), 5)


def _text(spark, d, kinds, names):
    df = tt(spark, d, "documents").select("doc_id", "text")
    e = text.TextEngine(kinds, encode_short=False).fit(df)
    return rounded(e.transform(df).select("doc_id", *[f"text_{n}" for n in names]))


_W = r"list_filter(regexp_split_to_array(coalesce(text,''), '[\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '')"


@query("txt_length", f"SELECT doc_id, length(coalesce(text,''))::INT AS text_char_length, len({_W})::INT AS text_word_count FROM documents")
def txt_length(spark, d):
    return _text(spark, d, ("stats",), ["char_length", "word_count"])


@query("txt_char_stats", r"SELECT doc_id, round(len(regexp_extract_all(text,'\p{Lu}'))/greatest(length(text),1),6) AS text_uppercase_ratio, round(len(regexp_extract_all(text,'\p{Nd}'))/greatest(length(text),1),6) AS text_digit_ratio, len(regexp_extract_all(text,'[.!?]+'))::INT AS text_sentence_count, len(regexp_extract_all(text,'[^a-zA-Z0-9\s]'))::INT AS text_special_char_count FROM documents")
def txt_char_stats(spark, d):
    df = t(spark, d, "documents").select("doc_id", "text")
    e = text.TextEngine(("stats",), encode_short=False).fit(df)
    out = e.transform(df).select("doc_id", "text_uppercase_ratio", "text_digit_ratio")
    p = text.TextEngine(("patterns",), encode_short=False).fit(df).transform(df).select(F.col("doc_id").alias("k"), "text_sentence_count", "text_special_char_count")
    return rounded(out.join(p, F.col("doc_id") == F.col("k")).drop("k"))


@query("txt_word_stats", f"SELECT doc_id, round(CASE WHEN len(w)=0 THEN 0 ELSE list_sum(list_transform(w, lambda x: length(x)))/len(w) END,6) AS text_avg_word_length, round(len(list_distinct(list_transform(w, lambda x: lower(x))))/greatest(len(w),1),6) AS text_unique_word_ratio FROM (SELECT doc_id, {_W} AS w FROM documents)")
def txt_word_stats(spark, d):
    return _text(spark, d, ("stats",), ["avg_word_length", "unique_word_ratio"])


@query("txt_patterns", r"SELECT doc_id, len(regexp_extract_all(text,'\p{Nd}'))::INT AS text_digit_count, len(regexp_extract_all(text,'!'))::INT AS text_exclamation_count, len(regexp_extract_all(text,'[?]'))::INT AS text_question_count FROM documents")
def txt_patterns(spark, d):
    return _text(spark, d, ("patterns",), ["digit_count", "exclamation_count", "question_count"])


@query("txt_tfidf")
def txt_tfidf(spark, d):
    return rounded(text.tfidf(t(spark, d, "conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn")), "id", "text"))


@query("txt_sentiment", "SELECT doc_id, round((p-n)/greatest(k,1),6) AS text_sentiment_score FROM (SELECT doc_id, len(w) AS k, len(list_filter(w, lambda x: list_contains([" + ",".join(f"'{w}'" for w in sorted(text.POSITIVE)) + "],x))) AS p, len(list_filter(w, lambda x: list_contains([" + ",".join(f"'{w}'" for w in sorted(text.NEGATIVE)) + "],x))) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text,'')),'[^a-z]+'), lambda x: x<>'') AS w FROM documents))")
def txt_sentiment(spark, d):
    return rounded(text.sentiment(t(spark, d, "documents"), "text").select("doc_id", "text_sentiment_score"))


_CF = ["c_acctbal", "c_nationkey"]


@query("sel_corr", "SELECT 'l_quantity' AS feature, round(abs(corr(l_quantity,l_extendedprice)),6) AS score FROM lineitem UNION ALL SELECT 'l_discount', round(abs(corr(l_discount,l_extendedprice)),6) FROM lineitem UNION ALL SELECT 'l_tax', round(abs(corr(l_tax,l_extendedprice)),6) FROM lineitem")
def sel_corr(spark, d):
    return rounded(scores.correlation(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


@query("sel_ftest_classif", "WITH d AS (SELECT 'c_acctbal' AS feature, c_acctbal AS x, c_mktsegment AS y FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::DOUBLE, c_mktsegment FROM customer), g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM d GROUP BY ALL) SELECT feature, round(((sum(n*m*m)-sum(n)*power(sum(n*m)/sum(n),2))/(count(*)-1))/(sum(n*v)/(sum(n)-count(*))),5) AS score FROM g GROUP BY 1")
def sel_ftest_classif(spark, d):
    return rounded(scores.f_test(t(spark, d, "customer"), _CF, "c_mktsegment"), 5)


@query("sel_ftest_reg", "SELECT 'l_quantity' AS feature, round(power(corr(l_quantity,l_extendedprice),2)/(1-power(corr(l_quantity,l_extendedprice),2))*(count(*)-2),4) AS score FROM lineitem UNION ALL SELECT 'l_tax', round(power(corr(l_tax,l_extendedprice),2)/(1-power(corr(l_tax,l_extendedprice),2))*(count(*)-2),4) FROM lineitem")
def sel_ftest_reg(spark, d):
    return rounded(scores.f_test(t(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice"), 4)


@query("sel_chi2", "WITH d AS (SELECT 'c_acctbal' AS feature, c_acctbal AS x, c_mktsegment AS y FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::DOUBLE, c_mktsegment FROM customer), l AS (SELECT *, min(x) OVER (PARTITION BY feature) AS lo, count(*) OVER (PARTITION BY feature) AS n FROM d), g AS (SELECT feature, y, sum(x-lo+1e-8) AS o, count(*) AS k, max(n) AS n FROM l GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY feature)*k/n AS e FROM g) SELECT feature, round(sum((o-e)*(o-e)/e),4) AS score FROM e GROUP BY 1")
def sel_chi2(spark, d):
    return rounded(scores.chi2(t(spark, d, "customer"), _CF, "c_mktsegment"), 4)


@query("sel_binned_mi", "WITH d AS (SELECT 'c_acctbal' AS feature, c_acctbal AS x, c_mktsegment AS y FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::DOUBLE, c_mktsegment FROM customer), l AS (SELECT *, min(x) OVER (PARTITION BY feature) AS lo, max(x) OVER (PARTITION BY feature) AS hi FROM d), c AS (SELECT feature, least(floor((x-lo)/(hi-lo)*16),15) AS b, y, count(*) AS k FROM l GROUP BY ALL), m AS (SELECT *, sum(k) OVER (PARTITION BY feature) AS n, sum(k) OVER (PARTITION BY feature,b) AS kb, sum(k) OVER (PARTITION BY feature,y) AS ky FROM c) SELECT feature, round(greatest(sum(k/n*ln(k*n/(kb*ky))),0),6) AS score FROM m GROUP BY 1")
def sel_binned_mi(spark, d):
    return rounded(scores.mutual_information(t(spark, d, "customer"), _CF, "c_mktsegment"))


@query("sel_corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r FROM lineitem" for a, b in combinations(LI, 2)))
def sel_corr_matrix(spark, d):
    m = scores.gram_correlation(t(spark, d, "lineitem"), LI)
    return spark.createDataFrame([(a, b, round(float(m[LI.index(a), LI.index(b)]), 6)) for a, b in combinations(LI, 2)], "a string, b string, r double")


@query("sel_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity)+(count(*) OVER (PARTITION BY l_quantity)-1)/2 AS a, rank() OVER (ORDER BY l_extendedprice)+(count(*) OVER (PARTITION BY l_extendedprice)-1)/2 AS b FROM lineitem) SELECT round(corr(a,b),6) AS score FROM r")
def sel_spearman(spark, d):
    return rounded(scores.spearman(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("sel_redundancy", "SELECT * FROM (VALUES ('l_quantity_copy')) v(dropped)")
def sel_redundancy(spark, d):
    df = t(spark, d, "lineitem").select(*LI).withColumn("l_quantity_copy", F.col("l_quantity") * 2)
    cols = df.columns
    gone = scores.redundant(cols, scores.gram_correlation(df, cols), dict.fromkeys(cols, 1.0), set(LI), 0.99)
    return spark.createDataFrame([(g,) for g in sorted(gone)], "dropped string")


def _labelled(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", F.length("text").alias("len"), F.expr("regexp_count(text, '!')").alias("bangs"), F.expr("size(split(text, ' '))").alias("blanks"), "quality")


@query("sel_importance_rf")
def sel_importance_rf(spark, d):
    imp = scores.importances(_labelled(spark, d), ["n_chars", "bangs", "blanks"], "quality")
    return spark.createDataFrame(sorted(imp.items()), "feature string, score double")


@query("sel_unified")
def sel_unified(spark, d):
    s = scores.FeatureSelector(max_features=5, original_features=["n_chars", "bangs"]).fit(_labelled(spark, d).drop("doc_id"), "quality")
    return spark.createDataFrame([(k, float(v), k in s.selected) for k, v in s.ranking()], "feature string, score double, selected boolean")


@query("gate_decision")
def gate_decision(spark, d):
    keep, gain = scores.gate(_labelled(spark, d), ["n_chars"], ["n_chars", "bangs", "blanks"], "quality", "doc_id")
    return spark.createDataFrame([(keep, float(gain))], "keep boolean, gain double")


@query("split_chronological", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events) SELECT event_id, (k > n - greatest(1, round(n*0.2)))::INT AS is_test FROM r")
def split_chronological(spark, d):
    return splits.chronological(t(spark, d, "events"), ["ts", "event_id"]).select("event_id", "is_test")


@query("split_stratified", "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= round(count(*) OVER (PARTITION BY lang)*0.2))::INT AS is_test FROM documents")
def split_stratified(spark, d):
    return splits.stratified(t(spark, d, "documents"), "lang", "doc_id", hashed=False).select("doc_id", "is_test")


@query("split_folds", "SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5)::INT AS fold FROM documents")
def split_folds(spark, d):
    return splits.folds(t(spark, d, "documents"), "doc_id", 5, "lang").select("doc_id", "fold")


@query("impute_median", "SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN value END, (SELECT median(value) FROM events WHERE event_type <> 'view')) AS value FROM events")
def impute_median(spark, d):
    ev = t(spark, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return splits.impute(ev, splits.medians(ev, ["value"]))


@query("store_asof", "WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view') SELECT e.event_id, f.value AS value FROM e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.ts")
def store_asof(spark, d):
    ev = t(spark, d, "events")
    e = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    f = ev.where("event_type = 'view'").select("user_id", "ts", "value")
    return as_of(e, f, ["user_id"], "ts").select("event_id", "value")


@query("store_latest", "SELECT user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1")
def store_latest(spark, d):
    return latest(t(spark, d, "events").select("user_id", "value", "ts", "event_id"), ["user_id"], "ts", ["event_id"]).select("user_id", "value", "ts")


@query("rule_ratio", "SELECT l_orderkey, l_linenumber, l_extendedprice/l_quantity AS unit_price FROM lineitem")
def rule_ratio(spark, d):
    r = TransformRule("unit_price", "result = df['price'] / df['quantity']", ["price", "quantity"])
    df = t(spark, d, "lineitem").select(*KEYS, "l_extendedprice", "l_quantity")
    return r.apply(df, r.matches(df.columns)).select(*KEYS, "unit_price")


@query("rule_zscore", "SELECT o_orderkey, round((o_totalprice-(SELECT avg(o_totalprice) FROM orders))/((SELECT stddev_samp(o_totalprice) FROM orders)+1e-8),6) AS z FROM orders")
def rule_zscore(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    sql, _ = compile_code("result = (df['o_totalprice'] - df['o_totalprice'].mean()) / (df['o_totalprice'].std() + 1e-8)", df)
    return rounded(df.select("o_orderkey", F.expr(sql).alias("z")))


@query("category_standardize", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'industry' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def category_standardize(spark, d):
    return standardise(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": "construction", "MACHINERY": "industry"})


@query("semantic_mock", "SELECT l_orderkey, l_linenumber, l_quantity/(l_extendedprice+1e-8::DOUBLE) AS l_quantity_l_extendedprice_ratio, l_quantity*l_extendedprice AS l_quantity_l_extendedprice_product, round((l_quantity-(SELECT avg(l_quantity) FROM lineitem))/(l_discount+1e-8::DOUBLE)/1e9, 9) AS l_quantity_normalized_by_l_discount, round((l_quantity-(SELECT avg(l_quantity) FROM lineitem))/((SELECT stddev_samp(l_quantity) FROM lineitem)+1e-8::DOUBLE), 6) AS l_quantity_zscore FROM lineitem")
def semantic_mock(spark, d):
    df = t(spark, d, "lineitem").select(*KEYS, *LI)
    e = SemanticEngine().fit(df.select(*LI))
    norm, z = "l_quantity_normalized_by_l_discount", "l_quantity_zscore"
    return e.transform(df).select(*KEYS, "l_quantity_l_extendedprice_ratio", "l_quantity_l_extendedprice_product", F.round(F.col(norm) / 1e9, 9).alias(norm), F.round(z, 6).alias(z))


@query("auto_pipeline", f"""WITH a AS (SELECT o_custkey, {_aggs('o_totalprice', 'orders')} FROM orders GROUP BY 1)
SELECT c_custkey, c_acctbal*c_acctbal AS c_acctbal_pow2, round(ln(1+abs(c_acctbal)),6) AS c_acctbal_log1p, round(sqrt(abs(c_acctbal)),6) AS c_acctbal_sqrt, a.* EXCLUDE (o_custkey),
round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment),6) AS c_acctbal_by_c_mktsegment_mean FROM customer LEFT JOIN a ON o_custkey = c_custkey""")
def auto_pipeline(spark, d):
    """The flagship: related-table and group aggregates with tabular features, in one plan."""
    rel = RelationalEngine(max_numeric=2).add_relationship("orders", "c_custkey", "o_custkey")
    eng = AutoFeatureEngineer(engines=("tabular", "relational"), relational=rel, tabular={"encode_categorical": False})
    df = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    out = eng.fit(df, related={"orders": t(spark, d, "orders").select("o_custkey", "o_totalprice")}).transform(df)
    names = ["c_custkey", "c_acctbal_pow2", "c_acctbal_log1p", "c_acctbal_sqrt", *[f"orders_o_totalprice_{a}" for a in ("mean", "sum", "count", "max", "min")], "c_acctbal_by_c_mktsegment_mean"]
    return out.select(*[F.round(n, 4 if n.endswith("_sum") else 6).alias(n) if n.endswith(("_mean", "_sum", "_log1p", "_sqrt")) else n for n in names])


from . import queries_more  # noqa: E402, F401 - registers the rest
