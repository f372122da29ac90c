"""Edge cases of the engines, and the parts that SQL does not reach."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfeat import cli
from sparkfeat.functions.compiler import CompileError, compile_code, validate
from sparkfeat.leakage import guard, leakage_columns, sanitise
from sparkfeat.operators import scores, splits, text
from sparkfeat.operators.relational import RelationalEngine, group_statistics
from sparkfeat.operators.tabular import TabularEngine, label_encode
from sparkfeat.operators.timeseries import TimeSeriesEngine, approximate_entropy, array_features, sample_entropy
from sparkfeat.plans.pipeline import AutoFeatureEngineer
from sparkfeat.registry import registry
from sparkfeat.rules import RuleStore, TransformRule
from sparkfeat.semantic import SemanticEngine, checked_mapping, generate_rule, parse, report, standardise
from sparkfeat.sources import io
from sparkfeat.sources.store import FeatureStore, as_of, latest
from sparkfeat.spec import FeatureOrigin, FeatureSet, FeatureSpec
from sparkfeat.streaming.push import transform_stream, windowed


def one(df, name):
    return df.select(name).first()[0]


def test_scalar_edges(spark):
    rows = [(1, 4e9, None), (2, float("nan"), 1.0), (3, float("inf"), 0.0), (4, -3.0, -1e-8), (5, 1e200, 2.0), (6, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    out = {r.id: r for r in TabularEngine(include_transforms=["exp", "reciprocal", "log"]).fit(df.select("x", "y")).transform(df).collect()}
    assert out[1].x_pow2 == 1.6e19 and out[1].x_x_y is None
    assert out[2].x_pow2 is None and out[3].x_pow2 is None and out[5].x_pow2 is None
    assert out[4].x_div_y is None and out[4].x_minus_y == -3.0 + 1e-8
    assert out[1].x_exp == math.exp(50) and out[1].y_exp is None
    assert TabularEngine(include_transforms=[], interaction_only=True).fit(df.select("x")).features.names == []
    with pytest.raises(ValueError):
        TabularEngine(polynomial_degree=5)
    with pytest.raises(KeyError):
        TabularEngine().fit(df.select("x", "y")).transform(df.select("x"))


def test_one_hot_and_target(spark):
    rows = [(k, "ab"[k % 2] if k % 10 else None, ["other", "q'x", "z"][k % 3], float(k)) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, c string, o string, y double")
    e = TabularEngine().fit(df.select("c", "o"))
    out = e.transform(df)
    r = out.where("c is null").first()
    assert (r.c_a, r.c_b, r.c_other) == (0, 0, 1)
    assert "o_other_" in out.columns and out.agg(F.sum("o_other")).first()[0] == 40
    unseen = spark.createDataFrame([(1, "new", "z", 0.0)], df.schema)
    assert e.transform(unseen).first().c_other == 1
    t = TabularEngine(one_hot_ratio=0.0, min_samples_per_category=3, interaction_only=True, include_transforms=[]).fit(df.select("c", "y"), "y")
    mean = sum(r[3] for r in rows) / len(rows)
    assert abs(t.transform(unseen).first().c_target_encoded - mean) < 1e-9
    assert label_encode(df, "c").where("c is null").first().c_encoded == -1


def test_relational(spark):
    orders = spark.createDataFrame([(1, 1, 100, "A"), (2, 1, 200, "B"), (3, 2, 150, "A"), (4, 2, 300, "A"), (5, None, 50, None)], "order_id int, customer_id int, amount int, category string")
    customers = spark.createDataFrame([(1, 25), (2, 35), (3, 45)], "customer_id int, age int")
    e = RelationalEngine(["mean", "count", "std", "sum"]).add_relationship("customers", "customer_id").add_relationship("absent", "customer_id")
    out = {r.order_id: r for r in e.fit_transform(orders, {"customers": customers}).collect()}
    assert out[1].customers_age_mean == 25 and out[1].customers_age_std is None and out[5].customers_age_mean is None
    assert abs(out[1].amount_by_category_mean - 550 / 3) < 1e-9 and out[1].amount_by_category_count == 3 and out[5].amount_by_category_mean is None
    with pytest.raises(ValueError):
        RelationalEngine().add_relationship("customers", "nope").transform(orders, {"customers": customers})
    nulls = spark.createDataFrame([(1, None)], "customer_id int, v double")
    s = RelationalEngine(["sum", "mean"], max_categorical=0).add_relationship("n", "customer_id").transform(orders, {"n": nulls}).where("customer_id = 1").first()
    assert s.n_v_sum == 0 and s.n_v_mean is None
    fit = RelationalEngine(stats="fit").fit(orders).transform(orders.limit(0))
    assert "amount_by_category_mean" in fit.columns
    assert group_statistics(orders, [], ["amount"]).columns == orders.columns


def test_series(spark):
    v = [0.0, 1.0, 1.0, 0.0, 2.0, 0.0]
    rows = [(1, k, x) for k, x in enumerate(v)] + [(2, 0, None), (3, 0, 5.0), (3, 1, 5.0), (3, 2, 5.0), (3, 3, 5.0), (4, 0, float("nan")), (4, 1, 7.0)]
    df = spark.createDataFrame(rows, "e int, t int, x double")
    groups = ["basic_stats", "distribution", "peaks", "trends", "fft", "entropy", "energy", "complexity", "counts"]
    out = {r.e: r for r in TimeSeriesEngine(["t"], ["e"], groups).transform(df, ["x"]).collect()}
    a = np.array(v)
    assert out[1].x_n_peaks == 2 and out[1].x_n_troughs == 1
    f = np.abs(np.fft.fft(a))
    assert np.allclose([out[1][f"x_fft_coeff_{k}"] for k in (1, 2, 3)], f[1:4]) and out[1].x_fft_coeff_4 is None
    assert abs(out[1].x_spectral_energy - (f**2).sum()) < 1e-9 and out[1].x_dominant_freq_idx == np.argmax(f[1:3]) + 1
    slope = np.polyfit(np.arange(6), a, 1)[0]
    assert abs(out[1].x_trend_slope - slope) < 1e-12 and out[1].x_length == 6
    assert out[1].x_longest_strike_above_mean == 2 and abs(out[1].x_cid_ce - math.sqrt((np.diff(a) ** 2).sum())) < 1e-12
    assert out[2].x_mean is None and out[2].x_length == 1
    assert out[3].x_binned_entropy is not None and abs(out[3].x_binned_entropy) < 1e-9 and out[3].x_sample_entropy == 0 and out[3].x_cv == 0
    assert out[4].x_mean == 7 and out[4].x_length == 2 and out[4].x_skewness is None
    whole = TimeSeriesEngine(["t"], None, ["basic_stats"]).broadcast_to(df, ["x"])
    assert whole.count() == len(rows)
    with pytest.raises(ValueError):
        TimeSeriesEngine([])


def test_entropies_by_loops():
    r = np.random.default_rng(0)
    v = r.standard_normal(60)
    tol = 0.2 * v.std()
    n = len(v)

    def matches(m, strict):
        e = [v[i : i + m] for i in range(n - m + 1)]
        return [[(np.max(np.abs(a - b)) < tol) if strict else (np.max(np.abs(a - b)) <= tol) for b in e] for a in e]

    b, a = (sum(x[i][j] for i in range(len(x)) for j in range(i + 1, len(x))) for x in (matches(2, True), matches(3, True)))
    assert abs(sample_entropy(v) + math.log(a / b)) < 1e-12
    phi = [np.mean([math.log(np.mean(row) + 1e-10) for row in matches(m, False)]) for m in (2, 3)]
    assert abs(approximate_entropy(v) - abs(phi[0] - phi[1])) < 1e-12


def test_arrays_and_text(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0, 5.0]), (2, []), (3, None), (4, [float("nan"), 3.0])], "id int, a array<double>")
    out = {r.id: r for r in array_features(df, "a").collect()}
    assert out[1].a_median == 3 and out[1].a_mean_abs_change == 4 / 3 and out[1].a_std == np.std([1, 2, 4, 5])
    assert out[2].a_mean is None and out[4].a_mean == 3 and out[3].a_sum is None
    t = spark.createDataFrame([(1, "Ärger  mit 42!? É x 😀"), (2, ""), (3, None)], "id int, s string")
    e = text.TextEngine(("stats", "patterns"))
    e.texts = ["s"]
    from sparkfeat.functions import expr as E

    got = {r.id: r for r in t.select("id", *[F.expr(v).alias(k) for k, v in E.text_features("s").items()]).collect()}
    s = "Ärger  mit 42!? É x 😀"
    assert got[1].char_length == len(s) and got[1].word_count == len(s.split()) and got[1].uppercase_ratio == 2 / len(s)
    assert got[1].special_char_count == 3 and got[2].word_count == 0 and got[3].unique_word_ratio == 0
    w = text.tfidf(spark.createDataFrame([(1, "red fox red"), (2, "fox den")], "id int, s string"), "id", "s").groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in w)
    svd = text.tfidf_svd(spark.createDataFrame([(k, f"red fox word{k} blue den{k % 3}") for k in range(8)], "id int, s string"), "id", "s", 2)
    assert svd.count() == 8 and len(svd.columns) == 3
    emb = text.embed(spark.createDataFrame([(k, [float(k), float(k % 3), 1.0]) for k in range(9)], "id int, v array<double>"), "id", "v", components=2)
    assert emb.columns == ["id", "v_emb_0", "v_emb_1"]


def test_models(spark):
    t = spark.createDataFrame([(1, "Ann saw Bob"), (2, None)], "id int, s string")
    ner = lambda xs: [{"person": sum(w.istitle() for w in x.split())} for x in xs]
    pos = lambda xs: [{"noun": 2, "verb": 1} if x else {} for x in xs]
    a = {r.id: r for r in text.named_entities(t, "s", ner).collect()}
    assert (a[1].s_ner_person, a[1].s_ner_total, a[2].s_ner_total) == (2, 2, 0)
    b = {r.id: r for r in text.parts_of_speech(t, "s", pos).collect()}
    assert b[1].s_pos_noun_ratio == 2 / 3 and b[1].s_pos_noun_verb_ratio == 2 and b[1].s_pos_content_ratio == 1 and b[2].s_pos_noun_ratio == 0
    assert text.named_entities(t, "s", None) is t
    c = text.sentiment(t, "s", lambda xs: [(0.5, 0.25, 0.25) for _ in xs]).first()
    assert c.s_sentiment_score == 0.25


def test_selection(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((400, 3))
    rows = [(k, *map(float, v), float(v[0] + 0.001), int(v[0] + v[1] > 0)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, noise double, twin double, y int")
    s = scores.FeatureSelector(("correlation", "f_test", "mutual_info", "chi2"), 4, original_features=["a"]).fit(df.drop("id"), "y")
    assert "twin" not in s.selected and "a" in s.selected and s.scores["noise"] < s.scores["b"]
    c = scores.gram_correlation(df.withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a"))), ["a", "b"])
    m = np.arange(400) % 7 != 0
    assert abs(c[0, 1] - np.corrcoef(x[m, 0], x[m, 1])[0, 1]) < 1e-9
    assert scores.redundant(["o1", "o2", "d"], np.array([[1, 1, 1], [1, 1, 1], [1, 1, 1.0]]), {}, {"o1", "o2"}) == {"d"}
    assert scores.kendall(df.limit(50), "a", "twin") == pytest.approx(1.0)
    imp = scores.importances(df, ["a", "noise"], "y", "gradient_boosting", trees=3)
    assert imp["a"] > imp["noise"]
    with pytest.raises(ValueError):
        scores.importances(df, ["a"], "y", "svm")
    keep, gain = scores.gate(df, ["noise"], ["noise", "a", "b"], "y", "id", splits=2, trees=10)
    assert keep and gain > 0.1
    with pytest.raises(ValueError):
        scores.FeatureSelector(("nope",))


def test_pipeline(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 2))
    df = spark.createDataFrame([(k, float(a), float(b), float(a * b)) for k, (a, b) in enumerate(x)], "id int, a double, b double, y double")
    e = AutoFeatureEngineer(max_features=6, selection_methods=("correlation",)).fit(df.drop("id"), "y")
    out = e.transform(df)
    assert "a_x_b" in out.columns and len([c for c in out.columns if c != "y"]) <= 6
    assert e.explain()["a_x_b"] and "*" in e.code()["a_x_b"]
    assert FeatureSet.from_json(e.features().to_json()).names == e.features().names
    before = e.get_params()
    with pytest.raises(ValueError):
        e.set_params(max_features=3, leakage="nope")
    assert e.get_params() == before
    for bad in ({"engines": ()}, {"engines": ("x",)}, {"max_features": 0}, {"use_gate": True}):
        with pytest.raises(ValueError):
            AutoFeatureEngineer(**bad)


def test_compiler_rules_and_semantics(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "ab"), (3.0, 0.0, None), (None, 1.0, "xb")], "p double, q double, s string")
    run = lambda code: [r[0] for r in df.select(F.expr(compile_code(code, df)[0])).collect()]
    assert run("result = df['p'] / df['q']") == [0.5, None, None]
    assert run("result = df['p'].fillna(0) + df['q'].max()") == [3.0, 5.0, 2.0]
    assert run("np.where(df['q'] > 1, 1, 0)") == [1.0, 0.0, 0.0]
    assert run("df['s'].str.len()") == [2, None, 2]
    assert run("log(df['p'])") == [math.log1p(1), math.log1p(3), None]
    for bad in ("import os", "result = __import__('os')", "result = df['nope']", "result = open('x')", "df['p'].apply(f)", "x = 1; y = 2"):
        with pytest.raises(CompileError):
            compile_code(bad, df)
    assert validate("df['p'] +", df)["valid"] is False and validate("df['p']", df)["warnings"]
    rule = TransformRule("ratio", "result = df['price'] / df['quantity']", ["price", "quantity"], tags=["money"], column_patterns=["^p$", "^q$"])
    assert rule.matches(["x", "q", "p"]) == {"price": "p", "quantity": "q"}
    assert [r.ratio for r in rule.apply(df, {"price": "p", "quantity": "q"}).collect()] == [0.5, None, None]
    store = RuleStore(str(tmp_path / "rules.json"))
    store.save(rule)
    again = RuleStore(str(tmp_path / "rules.json"))
    assert again.get_by_name("ratio").usage_count in (0, 1) and again.search("a ratio please")[0].id == rule.id and again.find_matching(["p", "q"])
    assert again.delete(rule.id) and not again.list()
    sem = SemanticEngine().fit(df)
    assert "p_q_ratio" in sem.features and sem.transform(df).count() == 3
    assert "# Features" in report(sem.features, sem.transform(df))
    assert generate_rule(df, "r", "ratio of p to q").apply(df).columns[-1] == "r"
    assert parse("say ```json\n{\"a\": 1}\n```") == {"a": 1} and parse("none") == {}
    assert checked_mapping('{"groups": {"G": ["AB", "zz"]}}', ["ab"]) == {"ab": "G"}
    assert [r.s for r in standardise(df, "s", {"ab": "G"}).collect()] == ["G", None, "xb"]
    f = registry.create_feature("p_log", "log", "p")
    assert f.compute(df).columns[-1] == "p_log"
    bad = FeatureSpec("bad", "no_such(p)")
    assert FeatureSet([f, bad]).compute_all(df).columns[-1] == "p_log"
    assert FeatureSet([f]).filter_by_origin(FeatureOrigin.CUSTOM).names == ["p_log"] and FeatureSet([f]).to_dataframe(spark).count() == 1


def test_leakage_and_splits(spark):
    assert leakage_columns(["a_label", "x", "y"], None) == ["a_label"] and leakage_columns(["a_label"], None, ()) == []
    with pytest.raises(ValueError):
        guard(["target_x"], None, "raise")
    with pytest.warns(UserWarning):
        guard(["target_x"], None, "warn")
    assert sanitise(["a b", "a-b", "??"]) == ["a_b", "a_b_1", "col"]
    df = spark.createDataFrame([(k, k // 3, "ab"[k % 2], None if k % 4 else float(k)) for k in range(30)], "id int, t int, c string, v double")
    c = splits.chronological(df, ["t", "id"], 0.25)
    assert sorted(r.id for r in c.where("is_test = 1").collect()) == list(range(22, 30))
    assert splits.stratified(df, "c", "id", 0.2).groupBy("c").agg(F.sum("is_test")).collect() and splits.folds(df, "id").count() == 30
    with pytest.raises(ValueError):
        splits.chronological(df, ["t"], 1.0)
    fill = splits.medians(df.withColumn("n", F.lit(None).cast("double")), ["v", "n"])
    assert fill == {"v": 14.0, "n": 0.0} and splits.impute(df, {"v": 1.5}).where("v is null").count() == 0
    assert splits.align(df.drop("c", "t"), df).first().c == "missing"
    assert splits.wilcoxon([1, 2, 3, 4, 5], [0, 0, 0, 0, 0]) == 2 / 32 and splits.wilcoxon([1], [2]) == 1.0
    m = splits.metrics(df.select(F.lit(1).alias("y"), F.lit(1).alias("p")), "y", "p", True)
    assert m["accuracy"] == 1.0


def test_store_and_streams(spark, tmp_path):
    f = spark.createDataFrame([("u", "2024-01-01 00:00:00", 1), ("u", "2024-01-01 02:00:00", 2), (None, "2024-01-01 00:00:00", 9)], "k string, ts string, v int").withColumn("ts", F.to_timestamp("ts"))
    e = spark.createDataFrame([(1, "u", "2024-01-01 01:00:00"), (2, "u", "2024-01-01 02:00:00"), (3, "u", "2023-12-31 00:00:00"), (4, None, "2024-01-02 00:00:00"), (5, "u", "2024-01-03 00:00:00")], "id int, k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.id: r.v for r in as_of(e, f, ["k"], "ts", ttl_seconds=7200).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None, 5: None}
    assert {r.k: r.v for r in latest(f, ["k"], "ts").collect()} == {"u": 2, None: 9}
    with FeatureStore(spark, str(tmp_path / "store")) as s:
        s.save(f, "view", ["k"], "ts", ttl_days=100000)
        s.materialise("view")
        assert s.online(e.select("k").distinct(), "view").where("k = 'u'").first().v == 2
        s.push("view", f.limit(1).withColumn("ts", F.to_timestamp(F.lit("2025-01-01"))).withColumn("v", F.lit(7)))
        assert s.online(e.select("k").distinct(), "view").where("k = 'u'").first().v == 7
        assert s.historical(e, "view", "ts").where("id = 1").first().v == 1 and s.views() == ["view"]
        with pytest.raises(ValueError):
            s.save(f, "bad", [])
        assert s.delete("view") and not s.delete("view")
    src = str(tmp_path / "in")
    df = spark.range(20).select(F.col("id").cast("double").alias("x"), F.timestamp_seconds(F.col("id") * 600).alias("t"))
    df.write.parquet(src)
    eng = TabularEngine().fit(df.select("x"))
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = transform_stream(stream, eng).writeStream.format("memory").queryName("plain").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("plain").count() == 20 and "x_pow2" in spark.table("plain").columns
    w = windowed(stream.withColumn("k", F.lit("a")), "t", ["k"], "x").writeStream.format("memory").queryName("win").outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("win").count() >= 1


def test_io_and_cli(spark, tmp_path, capsys):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2).cast("double").alias("z"), (F.col("id") % 2).cast("int").alias("y"))
    for fmt in ("csv", "parquet", "json"):
        p = str(tmp_path / f"t.{fmt}")
        io.write(df, p, single_file=True)
        assert io.read(spark, p, schema=None if fmt != "json" else "x double, z double, y int").count() == 50
    assert io.fingerprint(df) == io.fingerprint(df.orderBy(F.desc("x"))) != io.fingerprint(df.limit(49))
    with pytest.raises(ValueError):
        io.detect("a.xls")
    with pytest.raises(ValueError):
        io.read(spark, str(tmp_path / "none.parquet"))
    cache = io.TableCache(str(tmp_path / "cache"), most=1)
    cache.put("a", df)
    cache.put("b", df, why="test")
    assert cache.keys() == ["b"] and cache.metadata("b") == {"why": "test"} and cache.get(spark, "a") is None
    src, out = str(tmp_path / "t.parquet"), str(tmp_path / "out.parquet")
    assert cli.main(["transform", "--input", src, "--output", out, "--target", "y", "--max-features", "5"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "ok" and "y" not in spark.read.parquet(out).columns
    assert cli.main(["explain", "--input", src, "--target", "y"]) == 0
    assert json.loads(capsys.readouterr().out)["features"]
    (tmp_path / "c.json").write_text('{"nope": 1}')
    assert cli.main(["explain", "--input", src, "--config", str(tmp_path / "c.json")]) == 2
    assert cli.main(["transform", "--input", src, "--output", out, "--max-features", "5"]) == 2
    assert cli.main(["info"]) == 0 and cli.main(["what"]) == 2


def test_long_series(spark):
    n = 6000
    v = np.sin(2 * np.pi * 7 * np.arange(n) / n) + np.random.default_rng(0).normal(0, 0.1, n)
    df = spark.createDataFrame([("u", k, float(x)) for k, x in enumerate(v)] + [("w", k, float(k % 3)) for k in range(9)], "u string, i long, x double")
    got = {g: {r.u: r.asDict() for r in TimeSeriesEngine(["i"], ["u"], [g]).transform(df, ["x"]).collect()} for g in ("fft", "entropy")}
    assert got["fft"]["u"]["x_dominant_freq_idx"] == 7
    r = 0.2 * v.std()
    d = lambda m: [sum(int((np.abs(np.array([v[j : n - m + 1 + j] for j in range(m)]) - v[i : i + m, None]).max(axis=0)[i + 1 :] < r).sum()) for i in range(n - m + 1))]
    assert abs(got["entropy"]["u"]["x_sample_entropy"] + np.log(d(3)[0] / d(2)[0])) < 1e-4
    assert set(got["entropy"]) == {"u", "w"}
