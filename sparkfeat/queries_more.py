"""More registered queries with their SQL: sources and stores, profiles, encodings, splits and metrics, series in cells, selection with a label."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import scores, splits, text, timeseries
from .operators.profile import profile
from .operators.tabular import TabularEngine, ordinal_encode
from .operators.trading import indicators
from .parallel import parallel_apply
from .plans.ml import AutoFeatureEstimator
from .plans.pipeline import AutoFeatureEngineer
from .queries import _BASE, _W, KEYS, LI, SQL, query, rounded, t, tt
from .rules import RuleStore, TransformRule
from .semantic import frequent_values
from .sources import io
from .sources.shared import shared_folder
from .sources.store import FeatureStore
from .streaming.push import windowed

CUST = ["c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"]


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/queries/{uuid.uuid4().hex}"


# sources and sinks


def _round_trip(spark, d, suffix, schema, single):
    df = t(spark, d, "supplier")
    at = f"{_folder(spark)}/t.{suffix}"
    io.write(df, at, single_file=single)
    return io.read(spark, at, schema=schema).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query("io_csv", _SUPPLIER)
def io_csv(spark, d):
    return _round_trip(spark, d, "csv", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", True)


@query("io_json_records", _SUPPLIER)
def io_json_records(spark, d):
    return _round_trip(spark, d, "json", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", True)


@query("io_json_lines", _SUPPLIER)
def io_json_lines(spark, d):
    return _round_trip(spark, d, "jsonl", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", False)


@query("io_parquet", _SUPPLIER)
def io_parquet(spark, d):
    return _round_trip(spark, d, "pq", None, False)


@query("io_head_slice", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 77")
def io_head_slice(spark, d):
    return io.head_slice(t(spark, d, "events"), 77, ["ts", "event_id"]).select("event_id", "value")


@query("io_with_target", "SELECT p_partkey, p_size*p_size::DOUBLE AS p_size_pow2, p_retailprice FROM part")
def io_with_target(spark, d):
    df = t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    made = TabularEngine(include_transforms=[]).fit(df.select("p_size")).transform(df.select("p_partkey", "p_size")).drop("p_size")
    return io.with_target(made, df, "p_retailprice", ["p_partkey"])


@query("io_cache", "SELECT n_nationkey, n_name FROM nation")
def io_cache(spark, d):
    cache = io.TableCache(_folder(spark), most=1)
    cache.put("old", t(spark, d, "region"))
    cache.put("nations", t(spark, d, "nation").select("n_nationkey", "n_name"), why="test")
    assert cache.keys() == ["nations"]
    return cache.get(spark, "nations")


# columns


@query("col_profile", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, (count(*)-count({c})) AS nulls, count(DISTINCT {c}) AS distinct_values, " + (f"round(avg({c}),4) AS mean, round(stddev_samp({c}),4) AS std, NULL::DOUBLE AS mean_length" if num else f"NULL::DOUBLE, NULL::DOUBLE, round(avg(length({c})),4)") + " FROM customer" for c, num in (("c_acctbal", True), ("c_nationkey", True), ("c_mktsegment", False), ("c_name", False))))
def col_profile(spark, d):
    p = profile(t(spark, d, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment", "c_name"))
    r = lambda v: None if v is None else round(float(v), 4)
    return spark.createDataFrame([(k, v.n, v.nulls, v.distinct, r(v.mean), r(v.std), r(v.mean_length)) for k, v in p.items()], "name string, n long, nulls long, distinct_values long, mean double, std double, mean_length double")


@query("col_frequent_values", "SELECT p_name AS v FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 50")
def col_frequent_values(spark, d):
    return spark.createDataFrame([(v,) for v in frequent_values(t(spark, d, "part"), "p_name", 50)], "v string")


@query("col_select_existing", "SELECT c_mktsegment, c_custkey FROM customer")
def col_select_existing(spark, d):
    s = scores.FeatureSelector()
    s.set_selected_features(["c_mktsegment", "gone", "c_custkey"])
    return s.transform(t(spark, d, "customer"))


@query("col_align", "SELECT c_custkey, c_acctbal, 0 AS c_nationkey, 'missing' AS c_mktsegment FROM customer")
def col_align(spark, d):
    df = t(spark, d, "customer").select(*CUST)
    return splits.align(df.select("c_acctbal", "c_custkey").withColumn("more", F.lit(1)), df)


@query("feature_stats", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}),4) AS mean, round(stddev_samp({c}),4) AS std FROM lineitem" for c in LI))
def feature_stats(spark, d):
    df = t(spark, d, "lineitem").select(*LI)
    row = df.agg(*[x for k, c in enumerate(LI) for x in (F.count(c).alias(f"n{k}"), F.round(F.avg(c), 4).alias(f"mean{k}"), F.round(F.stddev_samp(c), 4).alias(f"std{k}"))])
    return scores._melted(row, LI, {"n": "long", "mean": "double", "std": "double"})


@query("leakage_by_rule", """SELECT name FROM (VALUES ('age'), ('my_target'), ('FutureSales'), ('price_label'), ('o_total'), ('width'), ('__'), ('leakage'), ('outcomes2'), ('totalprice'), ('o_totalprice_x')) v(name)
WHERE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') <> '' AND (regexp_matches(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'target|label|outcome|groundtruth|ytrue|future|leak')
OR contains('ototalprice', regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) OR contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'ototalprice'))""")
def leakage_by_rule(spark, d):
    from .leakage import leakage_columns

    names = ["age", "my_target", "FutureSales", "price_label", "o_total", "width", "__", "leakage", "outcomes2", "totalprice", "o_totalprice_x"]
    return spark.createDataFrame([(n,) for n in leakage_columns(names, "o_totalprice")], "name string")


# tabular


@query("tab_powers_to_4", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{'*'.join([c] * k)} AS {c}_pow{k}" for c in LI for k in (2, 3, 4)) + " FROM lineitem")
def tab_powers_to_4(spark, d):
    df = t(spark, d, "lineitem").select(*KEYS, *LI)
    e = TabularEngine(polynomial_degree=4, include_transforms=[]).fit(df.select(*LI))
    return e.transform(df).select(*KEYS, *[f"{c}_pow{k}" for c in LI for k in (2, 3, 4)])


@query("cat_target_string_label", "WITH y AS (SELECT *, dense_rank() OVER (ORDER BY p_type) - 1 AS y FROM part), m AS (SELECT p_brand, avg(y) AS m FROM y GROUP BY 1 HAVING count(*) >= 3) SELECT p_partkey, round(coalesce(m, (SELECT avg(y) FROM y)), 6) AS p_brand_target_encoded FROM part LEFT JOIN m USING (p_brand)")
def cat_target_string_label(spark, d):
    df = t(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    e = TabularEngine(one_hot_ratio=0.0, include_transforms=[], interaction_only=True).fit(df.select("p_brand", "p_type"), "p_type")
    return rounded(e.transform(df).select("p_partkey", "p_brand_target_encoded"))


@query("cat_max_one_hot", "WITH m AS (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1 HAVING count(*) >= 3) SELECT p_partkey, round(coalesce(m, (SELECT avg(p_retailprice) FROM part)), 6) AS p_brand_target_encoded FROM part LEFT JOIN m USING (p_brand)")
def cat_max_one_hot(spark, d):
    """Columns of more categories than the bound are encoded by target."""
    df = t(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    e = TabularEngine(one_hot_ratio=0.5, max_one_hot=10, include_transforms=[], interaction_only=True).fit(df.select("p_brand", "p_retailprice"), "p_retailprice")
    return rounded(e.transform(df).select("p_partkey", "p_brand_target_encoded"))


@query("cat_ordinal_train_only", "WITH v AS (SELECT coalesce(c_mktsegment, 'missing') AS s FROM customer WHERE c_nationkey < 12 AND c_mktsegment <> 'BUILDING' GROUP BY 1), k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM v) SELECT c_custkey, coalesce(code, (SELECT count(*) FROM v))::INT AS c_mktsegment FROM customer LEFT JOIN k ON s = coalesce(c_mktsegment, 'missing') WHERE c_nationkey >= 12")
def cat_ordinal_train_only(spark, d):
    df = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    _, test = ordinal_encode(df.where("c_nationkey < 12 and c_mktsegment <> 'BUILDING'"), df.where("c_nationkey >= 12"), ["c_mktsegment"])
    return test.select("c_custkey", "c_mktsegment")


@query("cat_gate_encoding", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS o_orderpriority, epoch(o_orderdate)::DOUBLE AS o_orderdate, (o_totalprice > 100000)::INT AS big FROM orders")
def cat_gate_encoding(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", (F.col("o_totalprice") > 100000).alias("big"), F.array("o_totalprice").alias("nested"))
    out, kept = scores.encoded(df, ["o_orderpriority", "o_orderdate", "big", "nested"])
    return out.select("o_orderkey", *kept)


@query("txt_encode_short", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS c_mktsegment_encoded FROM customer")
def txt_encode_short(spark, d):
    df = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return text.TextEngine().fit(df).transform(df)


# text


@query("txt_space_special", r"SELECT doc_id, round(len(regexp_extract_all(text, '[\s\x0B\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))/greatest(length(text),1),6) AS text_space_ratio, len(regexp_extract_all(text, '[^\p{L}\p{N}\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))::INT AS text_special_char_count FROM documents")
def txt_space_special(spark, d):
    df = tt(spark, d, "documents").select("doc_id", "text")
    e = text.TextEngine(("stats",), encode_short=False).fit(df)
    return rounded(e.transform(df).select("doc_id", "text_space_ratio", "text_special_char_count"))


@query("txt_caps_words", f"SELECT doc_id, round(len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x))/greatest(len(w),1),6) AS text_caps_word_ratio FROM (SELECT doc_id, {_W} AS w FROM documents)")
def txt_caps_words(spark, d):
    df = tt(spark, d, "documents").select("doc_id", "text")
    return rounded(text.TextEngine(("patterns",), encode_short=False).fit(df).transform(df).select("doc_id", "text_caps_word_ratio"))


@query("txt_tfidf_svd")
def txt_tfidf_svd(spark, d):
    """Projections on singular vectors, which no SQL gives; the tests hold them against an exact decomposition."""
    return text.tfidf_svd(t(spark, d, "conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn")), "id", "text", components=8)


#: The English list of Spark's StopWordsRemover, in its order: the SQL must not depend on where Spark's own files lie.
_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split()


def _tfidf_sql() -> str:
    stop = ",".join("'" + w.replace("'", "''") + "'" for w in _STOP_WORDS)
    return rf"""WITH w AS (SELECT conv_id || '/' || turn AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}\p{{M}}_]{{2,}}')) AS term FROM conversations),
tf AS (SELECT id, term, count(*) AS tf FROM w WHERE term NOT IN ({stop}) GROUP BY ALL),
k AS (SELECT term, ln((1 + (SELECT count(*) FROM conversations)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
x AS (SELECT id, term, tf * idf AS w FROM tf JOIN k USING (term))
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM x"""


SQL["txt_tfidf"] = _tfidf_sql()


# series


_FROM_CELLS = "WITH events AS (SELECT vec_id AS user_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS ts, 0 AS event_id FROM embeddings), "


def _cells(group: str, digits: dict[str, int] | int, names: list[str] | None = None):
    def run(spark, d):
        out = timeseries.array_features(tt(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("value")), "value", [group]).drop("value")
        at = lambda c: digits if isinstance(digits, int) else next((n for k, n in digits.items() if k in c), 6)
        cols = out.columns if names is None else ["user_id", *[f"value_{n}" for n in names]]
        return out.select(*[F.round(c, at(c)).alias(c) if k == "double" else c for c, k in out.dtypes if c in cols])

    return run


for _name, _group, _digits, _names in (
    ("basic_stats", "basic_stats", 6, None),
    ("distribution", "distribution", 6, None),
    ("autocorr", "autocorrelation", 6, None),
    ("peaks", "peaks", 6, None),
    ("trends", "trends", 6, None),
    ("rolling", "rolling", 6, None),
    ("fft", "fft", {"energy": 2, "coeff": 4}, [*[f"fft_coeff_{k}" for k in range(1, 11)], "spectral_energy"]),
    ("binned_entropy", "entropy", 6, ["binned_entropy"]),
    ("energy", "energy", {"abs_energy": 4, "crest": 4, "": 5}, None),
    ("complexity", "complexity", {"c3": 2, "": 4}, None),
    ("counts", "counts", 6, None),
):
    query(f"ts_cells_{_name}", _FROM_CELLS + SQL[f"ts_{_name}"].lstrip().removeprefix("WITH "))(_cells(_group, _digits, _names))


SQL["ts_dominant_freq"] = _BASE.rstrip() + """, k AS (SELECT user_id, k, sqrt(power(sum(x*cos(2*pi()*k*i/n)),2)+power(sum(x*sin(2*pi()*k*i/n)),2)) AS a FROM s JOIN range(1, 100000) r(k) ON k < n//2 WHERE n >= 4 GROUP BY ALL)
SELECT u.user_id, CASE WHEN u.n >= 4 THEN coalesce(arg_max(k.k, (round(k.a, 9), -k.k)), 1)::DOUBLE END AS value_dominant_freq_idx FROM (SELECT user_id, max(n) AS n FROM s GROUP BY 1) u LEFT JOIN k USING (user_id) GROUP BY u.user_id, u.n"""

SQL["ts_entropy_pairs"] = _BASE.rstrip() + """, r AS (SELECT user_id, i, x, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2, n, 0.2*stddev_pop(x) OVER (PARTITION BY user_id) AS r FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
p AS (SELECT a.user_id, a.i, a.n, a.r, a.x2 IS NOT NULL AND b.x2 IS NOT NULL AS three,
greatest(abs(a.x-b.x), abs(a.x1-b.x1)) AS d2, greatest(abs(a.x-b.x), abs(a.x1-b.x1), abs(a.x2-b.x2)) AS d3, a.i < b.i AS up
FROM r a JOIN r b ON a.user_id = b.user_id AND a.x1 IS NOT NULL AND b.x1 IS NOT NULL),
e AS (SELECT user_id, max(n) AS n, max(r) AS r, count(*) FILTER (up AND d2 < r) AS b, count(*) FILTER (up AND three AND d3 < r) AS a FROM p GROUP BY 1),
c AS (SELECT user_id, i, max(n) AS n, count(*) FILTER (d2 <= r) AS c2, bool_or(three) AS has3, count(*) FILTER (three AND d3 <= r) AS c3 FROM p GROUP BY ALL),
f AS (SELECT user_id, avg(ln(c2/(n-1)+1e-10)) AS phi2, avg(ln(c3/(n-2)+1e-10)) FILTER (has3) AS phi3 FROM c GROUP BY 1)
SELECT u.user_id, CASE WHEN u.n >= 4 THEN round(CASE WHEN e.r = 0 OR e.a = 0 OR e.b = 0 THEN 0 ELSE -ln(e.a/e.b) END, 6) END AS value_sample_entropy,
CASE WHEN u.n >= 4 THEN round(CASE WHEN e.r = 0 THEN 0 ELSE abs(phi2-phi3) END, 6) END AS value_approximate_entropy FROM (SELECT user_id, max(n) AS n FROM s GROUP BY 1) u LEFT JOIN e USING (user_id) LEFT JOIN f USING (user_id)"""


def _whole(group: str, digits: int, names: list[str] | None = None):
    def run(spark, d):
        out = timeseries.TimeSeriesEngine(["ts", "event_id"], None, [group]).transform(t(spark, d, "events"), ["value"])
        return out.select(*[F.round(c, digits).alias(c) if k == "double" else c for c, k in out.dtypes if names is None or c in names])

    return run


def _one_series(sql: str) -> str:
    """The same SQL over the whole table as the one series."""
    return "WITH events AS (SELECT * EXCLUDE (user_id), 0 AS user_id FROM main.events), " + sql.lstrip().removeprefix("WITH ").rstrip()


for _name, _group in (("trends", "trends"), ("autocorr", "autocorrelation"), ("peaks", "peaks"), ("rolling", "rolling"), ("counts", "counts"), ("complexity", "complexity")):
    _digits = 4 if _name == "complexity" else 6
    _sql = _one_series(SQL[f"ts_{_name}"])
    query(f"ts_whole_{_name}", f"SELECT * EXCLUDE (user_id) FROM ({_sql})")(_whole(_group, _digits))
SQL["ts_whole_complexity"] = SQL["ts_whole_complexity"].replace("round(avg(x*p1*p2), 2)", "round(avg(x*p1*p2), 4)")


_EMA = lambda s: f"list_sum(list_transform(h, lambda v, i: v*power({1 - 2 / (s + 1)!r}, i-1)))/list_sum(list_transform(h, lambda v, i: power({1 - 2 / (s + 1)!r}, i-1)))"


@query("ts_indicators", f"""WITH s AS (SELECT event_id, user_id, ts, value, value/lag(value) OVER w - 1 AS c, row_number() OVER w AS k, lead(value) OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, list_reverse(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 199 PRECEDING)) AS h FROM s)
SELECT event_id, """ + ", ".join(f"round(CASE WHEN k>={n} THEN avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS {n - 1} PRECEDING) END, 6) AS value_sma_{n}, round(CASE WHEN k>{n} THEN stddev_samp(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS {n - 1} PRECEDING) END, 4) AS value_vol_{n}" for n in (5, 10, 20)) + f", round({_EMA(12)}, 6) AS value_ema_12, round({_EMA(26)}, 6) AS value_ema_26, (nx > value)::INT AS value_up_next FROM r")
def ts_indicators(spark, d):
    out = indicators(t(spark, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"])
    return out.select("event_id", *[F.round(c, 4 if "_vol_" in c else 6).alias(c) if k == "double" else c for c, k in out.dtypes if c.startswith("value_")])


# selection


@query("sel_task", " UNION ALL ".join(f"SELECT '{c}' AS label, {e} AS classification FROM customer" for c, e in (("c_mktsegment", "bool_and(true)"), ("c_nationkey", "count(DISTINCT c_nationkey) <= 0.1*count(c_nationkey)"), ("c_custkey", "count(DISTINCT c_custkey) <= 0.1*count(c_custkey)"), ("c_acctbal", "bool_or(false)"))))
def sel_task(spark, d):
    df = t(spark, d, "customer")
    return spark.createDataFrame([(c, bool(scores.is_classification(df, c))) for c in ("c_mktsegment", "c_nationkey", "c_custkey", "c_acctbal")], "label string, classification boolean")


_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber"))


@query("sel_threshold_top_k", f"SELECT feature, row_number() OVER (ORDER BY score DESC) AS place FROM (SELECT * FROM ({_CORR}) WHERE score >= 0.0001 ORDER BY score DESC LIMIT 2)")
def sel_threshold_top_k(spark, d):
    got = {r["feature"]: r["score"] for r in scores.correlation(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice").collect()}
    return spark.createDataFrame([(f, k + 1) for k, f in enumerate(scores.top(got, 0.0001, 2))], "feature string, place long")


_SCORES = f"""m AS ({SQL['sel_binned_mi'].replace('round(greatest(sum(k/n*ln(k*n/(kb*ky))),0),6)', 'greatest(sum(k/n*ln(k*n/(kb*ky))),0)')}),
f AS ({SQL['sel_ftest_classif'].replace('round(((sum', '(((sum').replace(',5) AS score', ') AS score')}),
y AS (SELECT *, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS y FROM customer),
r AS (SELECT 'c_acctbal' AS feature, abs(corr(c_acctbal, y)) AS score FROM y UNION ALL SELECT 'c_nationkey', abs(corr(c_nationkey, y)) FROM y),
a AS (SELECT 1 AS k, * FROM m UNION ALL SELECT 2, * FROM f UNION ALL SELECT 3, * FROM r),
s AS (SELECT feature, score / max(score) OVER (PARTITION BY k) AS share FROM a)"""


@query("sel_combined", f"WITH {_SCORES} SELECT feature, round(avg(share), 6) AS score FROM s GROUP BY 1")
def sel_combined(spark, d):
    s = scores.FeatureSelector().fit(t(spark, d, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment"), "c_mktsegment")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in s.scores.items()], "feature string, score double")


@query("sel_kendall", "WITH s AS (SELECT s_nationkey AS a, s_acctbal AS b, s_suppkey AS k FROM supplier), p AS (SELECT sign(x.a-y.a) AS da, sign(x.b-y.b) AS db FROM s x JOIN s y ON x.k < y.k) SELECT round(sum(da*db)/sqrt(count(*) FILTER (da<>0)::DOUBLE*count(*) FILTER (db<>0)), 9) AS tau FROM p")
def sel_kendall(spark, d):
    return spark.createDataFrame([(round(scores.kendall(t(spark, d, "supplier"), "s_nationkey", "s_acctbal", block=32), 9),)], "tau double")


SQL["sel_redundancy"] = "SELECT 'l_quantity_copy' AS dropped FROM lineitem HAVING abs(corr(l_quantity, l_quantity * 2)) >= 0.99"


@query("auto_selected", "SELECT p_partkey, p_size, p_retailprice, p_size*p_retailprice AS p_size_x_p_retailprice, p_size*p_retailprice + p_partkey % 7 AS y FROM part")
def auto_selected(spark, d):
    """Engines, scores, cap and gate with a label: of all derived features the one that tells the label is kept, and helps."""
    df = t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") * F.col("p_retailprice") + F.col("p_partkey") % 7).alias("y"))
    e = AutoFeatureEngineer(max_features=4, use_gate=True, gate_key="p_partkey", correlation_threshold=1.0).fit(df, "y")
    return e.transform(df)


@query("ml_pipeline", "SELECT c_custkey, c_acctbal, c_acctbal*c_acctbal AS c_acctbal_pow2 FROM customer")
def ml_pipeline(spark, d):
    """Saved and loaded as a stage of a Spark ML pipeline before it is applied."""
    from pyspark.ml import Pipeline, PipelineModel

    df = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    model = Pipeline(stages=[AutoFeatureEstimator(engines=("tabular",), tabular={"include_transforms": []})]).fit(df.select("c_acctbal"))
    at = _folder(spark)
    model.write().save(at)
    return PipelineModel.load(at).transform(df).select("c_custkey", "c_acctbal", "c_acctbal_pow2")


@query("auto_timeseries", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id), 6) AS value_mean, round(stddev_pop(value) OVER (PARTITION BY user_id), 6) AS value_std, round(max(value) OVER (PARTITION BY user_id), 6) AS value_max FROM events")
def auto_timeseries(spark, d):
    df = t(spark, d, "events").select("event_id", "user_id", "ts", "value")
    e = AutoFeatureEngineer(engines=("timeseries",), timeseries={"order_cols": ["ts", "event_id"], "entity_cols": ["user_id"], "columns": ["value"], "features": ["basic_stats"]}).fit(df)
    return rounded(e.transform(df).select("event_id", "value_mean", "value_std", "value_max"))


# splits and metrics


@query("split_time_folds", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events) SELECT event_id, greatest(0, floor((k - (n - 5*(n//6))) / (n//6)) + 1)::INT AS block FROM r")
def split_time_folds(spark, d):
    return splits.time_folds(t(spark, d, "events"), ["ts", "event_id"], 5).select("event_id", "block")


def _predicted(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("quality", (F.col("n_chars") > 1500).cast("int").alias("guess"), (F.col("n_chars") % 97).alias("score"))


_PRED = "WITH p AS (SELECT quality AS y, (n_chars > 1500)::INT AS g, n_chars % 97 AS s FROM documents JOIN labels USING (doc_id))"


@query("metric_classes", f"{_PRED}, c AS (SELECT k, count(*) FILTER (y=k AND g=k) AS tp, count(*) FILTER (y<>k AND g=k) AS fp, count(*) FILTER (y=k AND g<>k) AS fn FROM p, (VALUES (0), (1)) v(k) GROUP BY 1) SELECT (SELECT round(avg((y=g)::INT), 6) FROM p) AS accuracy, round(sum((tp+fn)*coalesce(2*tp/nullif(2*tp+fp+fn,0),0))/sum(tp+fn), 6) AS f1 FROM c")
def metric_classes(spark, d):
    m = splits.metrics(_predicted(spark, d), "quality", "guess", True)
    return spark.createDataFrame([(round(m["accuracy"], 6), round(m["f1"], 6))], "accuracy double, f1 double")


@query("metric_roc_auc", f"{_PRED} SELECT round(sum(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END)/count(*), 9) AS roc_auc FROM p a, p b WHERE a.y = 1 AND b.y = 0")
def metric_roc_auc(spark, d):
    return spark.createDataFrame([(round(splits.roc_auc(_predicted(spark, d), "quality", "score"), 9),)], "roc_auc double")


@query("metric_regression", "WITH p AS (SELECT o_totalprice AS y, 100000 + (o_orderkey % 1000) * 50.0 AS g FROM orders) SELECT round(1-sum((y-g)*(y-g))/sum((y-(SELECT avg(y) FROM p))*(y-(SELECT avg(y) FROM p))),6) AS r2, round(sqrt(avg((y-g)*(y-g))),3) AS rmse, round(avg(abs(y-g)),3) AS mae FROM p")
def metric_regression(spark, d):
    df = t(spark, d, "orders").select(F.col("o_totalprice").alias("y"), (100000 + (F.col("o_orderkey") % 1000) * 50.0).alias("g"))
    m = splits.metrics(df, "y", "g", False)
    return spark.createDataFrame([(round(m["r2"], 6), round(m["rmse"], 3), round(m["mae"], 3))], "r2 double, rmse double, mae double")


# stores, rules, rows, streams


@query("store_online", "SELECT u.user_id, arg_max(value, (ts, event_id)) AS value FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0) u LEFT JOIN events USING (user_id) GROUP BY 1")
def store_online(spark, d):
    """Saved as a view, materialised, and read as latest values."""
    ev = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    with FeatureStore(spark, _folder(spark)) as s:
        s.save(ev, "clicks", ["user_id"], "ts", ttl_days=0)
        s.materialise("clicks")
        return s.online(ev.where("user_id % 2 = 0").select("user_id").distinct(), "clicks").select("user_id", "value")


@query("store_push", "WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, value FROM e")
def store_push(spark, d):
    """An older half is materialised, the newer half is pushed over it."""
    ev = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    with FeatureStore(spark, _folder(spark)) as s:
        s.save(ev.where("pmod(xxhash64(ts), 2) = 0"), "clicks", ["user_id"], "ts", ttl_days=0)
        s.materialise("clicks")
        s.push("clicks", ev.where("pmod(xxhash64(ts), 2) = 1"))
        assert s.views() == ["clicks"] and s.schema("clicks")["fields"]
        return s.online(ev.select("user_id").distinct(), "clicks").select("user_id", "value")


@query("store_historical_ttl", "WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, ts AS fts, value FROM events WHERE event_type = 'view') SELECT e.event_id, CASE WHEN e.ts - f.fts <= INTERVAL 2 DAY THEN f.value END AS value FROM e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.fts")
def store_historical_ttl(spark, d):
    ev = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    with FeatureStore(spark, _folder(spark)) as s:
        s.save(ev.where("event_type = 'view'").select("user_id", "ts", "value"), "views", ["user_id"], "ts", ttl_days=2)
        return s.historical(ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), "views", "ts").select("event_id", "value")


@query("rule_store", "SELECT s_suppkey, s_acctbal*s_acctbal AS squared FROM supplier")
def rule_store(spark, d):
    """Saved to a store, found again by the columns at hand and applied to them."""
    store = RuleStore()
    store.save(TransformRule("other", "result = df['x'] / df['y']", ["x", "y"]))
    store.save(TransformRule("squared", "result = df['acctbal'] * df['acctbal']", ["acctbal"], tags=["money"]))
    df = t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    rule, at = next((r, m) for r, m in store.find_matching(df.columns, ["money"]))
    return rule.apply(df, at).select("s_suppkey", "squared")


@query("row_function", "SELECT n_nationkey, length(n_name)*10.0 + n_regionkey AS made FROM nation")
def row_function(spark, d):
    return parallel_apply(t(spark, d, "nation"), lambda r: len(r["n_name"]) * 10.0 + r["n_regionkey"], "made").select("n_nationkey", "made")


@query("stream_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """The events as a stream of one batch, counted by day."""
    src = t(spark, d, "events")
    at = _folder(spark)
    src.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(at)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(at)
    name = f"windows_{uuid.uuid4().hex}"
    windowed(stream, "ts", ["event_type"], "value", "1 day").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))

