"""The parts that queries do not reach: stages saved and loaded, backends, data sets, row functions, reports, whole texts, sinks."""

import bisect
import json
import math
import random
import time
from collections import Counter
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from sparkfeat import cli, comparison, datasets, llm_clients, queries as qs
from sparkfeat.operators import scores, splits, text
from sparkfeat.operators.arrays import array_series
from sparkfeat.operators.order import ordered, sums_before
from sparkfeat.operators.relational import RelationalEngine
from sparkfeat.operators.tabular import TabularEngine, ordinal_encode
from sparkfeat.operators.timeseries import TimeSeriesEngine
from sparkfeat.operators.trading import indicators
from sparkfeat.parallel import parallel_apply, parallel_transform
from sparkfeat.plans.ml import AutoFeatureEstimator, AutoFeatureModel, FeatureEngineerTransformer
from sparkfeat.plans.pipeline import AutoFeatureEngineer
from sparkfeat.semantic import MockLLM, SemanticEngine, domain_features, explain_feature, standardise_with
from sparkfeat.sources import io
from sparkfeat.sources.store import FeatureStore


def frame(spark, n=300):
    r = np.random.default_rng(1)
    x = r.standard_normal((n, 2))
    return spark.createDataFrame([(k, float(a), float(b), "pqr"[k % 3], float(a * b + 0.01 * k / n)) for k, (a, b) in enumerate(x)], "id int, a double, b double, c string, y double")


def test_stages_are_saved_and_loaded(spark, tmp_path):
    df = frame(spark)
    related = spark.createDataFrame([("p", 1.0), ("q", 2.0), ("q", 4.0)], "c string, v double")
    rel = RelationalEngine(["mean"], stats="fit").add_relationship("rel", "c")
    est = AutoFeatureEstimator("y", {"rel": related}, engines=("tabular", "relational", "text", "semantic"), relational=rel, max_features=7, leakage="off")
    model = Pipeline(stages=[est]).fit(df)
    want = model.transform(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = AutoFeatureModel.read().load(str(tmp_path / "m" / "stages" / f"0_{PipelineModel.load(str(tmp_path / 'm')).stages[0].uid}"), {"rel": related})
    got = again.transform(df)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert again.engineer.feature_importances == model.stages[0].engineer.feature_importances
    one = FeatureEngineerTransformer("tabular", include_transforms=["sqrt"], interaction_only=True).fit(df.select("a", "b"))
    assert "a_x_b" in one.transform(df).columns and "a_sqrt" in one.transform(df).columns
    with pytest.raises(ValueError):
        AutoFeatureEstimator(engines=("nope",))


def test_orchestrator(spark):
    df = frame(spark).withColumn("t", F.col("id"))
    for bad in ({"engines": ("timeseries",)}, {"selection_methods": ()}, {"gate_trees": 0}, {"correlation_threshold": 0}):
        with pytest.raises(ValueError):
            AutoFeatureEngineer(**bad)
    e = AutoFeatureEngineer(engines=("tabular", "timeseries"), timeseries={"order_cols": ["t"], "entity_cols": ["c"], "columns": ["a"], "features": ["trends"]}, max_features=9, use_gate=True, gate_key="id", gate_splits=2, gate_trees=10)
    out = e.fit(df, "y").transform(df)
    assert "a_x_b" in out.columns and e.gate_result[0] and len(out.columns) <= 10
    e.set_selected_features(["b", "a"])
    assert set(e.transform(df).columns) == {"a", "b", "y"}
    e.set_params(max_features=5)
    assert e.selector is None and not e.fitted
    # where an original tells all, nothing more passes the gate, whatever its kind
    noise = df.select("id", "c", "a", F.randn(3).alias("z"), F.current_timestamp().alias("when"), (F.col("id") % 2 == 0).alias("flag"), F.array("a").alias("nested"), (F.col("a") > 0).cast("int").alias("y"))
    assert scores.gate(noise, ["a"], ["a", "z", "c", "when", "flag", "nested"], "y", "id", splits=2, trees=5)[0] is False
    assert scores.gate(noise, ["nested"], ["nested"], "y", "id") == (False, 0.0)
    assert scores.top({"a": 1.0, "b": 3.0, "c": 3.0}, 2.0) == ["b", "c"] and scores.top({"a": 1.0, "b": 3.0}, None, 1) == ["b"]


def test_backends(spark):
    df = spark.createDataFrame([(70.0, 1.8, 130.0, 80.0)], "weight double, height double, systolic_bp double, diastolic_bp double")
    sent = []

    def send(request, timeout):
        sent.append((request.full_url, json.loads(request.data), dict(request.headers)))
        return json.dumps({"choices": [{"message": {"content": json.dumps({"features": [{"name": "w2", "code": "result = df['weight'] * 2"}, {"name": "bad", "code": "import os"}]})}}]}).encode()

    e = SemanticEngine(llm_clients.ChatClient("http://llm.invalid/v1", "m", send=send), domain="healthcare", task="risk").fit(df)
    assert {"body_mass_index", "pulse_pressure", "w2"} <= set(e.features.names) and "bad" in e.rejected
    assert sent[0][1]["model"] == "m" and "risk" in sent[0][1]["messages"][1]["content"]
    assert abs(e.transform(df).first().body_mass_index - 70 / 1.8**2) < 1e-6
    with pytest.warns(UserWarning):
        assert json.loads(llm_clients.Fallback(llm_clients.ChatClient("http://llm.invalid", "m", send=lambda *_: (_ for _ in ()).throw(OSError("down")))).complete('["a", "b"]'))["features"]
    lib = llm_clients.LibraryClient(lambda model, messages: {"choices": [{"message": {"content": "two times the weight"}}]}, "m")
    f = e.features.get("w2")
    assert explain_feature(f, lib) == "two times the weight" and explain_feature(f, MockLLM()).startswith("made of")
    group = llm_clients.LibraryClient(lambda **_: {"choices": [{"message": {"content": '{"groups": {"yes": ["Y", "ja"]}}'}}]}, "m")
    got = standardise_with(spark.createDataFrame([("Y",), ("ja",), ("no",), (None,)], "s string"), "s", group)
    assert [r.s for r in got.collect()] == ["yes", "yes", "no", None]
    assert isinstance(llm_clients.client(), MockLLM) and llm_clients.Models().is_valid("mock-small") and not llm_clients.Models().is_valid("x")
    with pytest.warns(UserWarning):
        assert llm_clients.Models(lambda: (_ for _ in ()).throw(OSError())).is_valid("any")
    assert [f["name"] for f in domain_features(df, "healthcare")] == ["body_mass_index", "pulse_pressure"]
    for call in (lambda: llm_clients.client("nope"), lambda: SemanticEngine(domain="nope"), lambda: domain_features(df, "nope")):
        with pytest.raises(ValueError):
            call()


def test_data_sets_and_comparison(spark):
    assert "credit_risk" in datasets.names("business") and datasets.info("xor_classification")["task"] == "classification"
    for bad in (lambda: datasets.names("x"), lambda: datasets.info("x")):
        with pytest.raises(ValueError):
            bad()
    for name in datasets.names():
        df = datasets.load(spark, name, 200)
        assert df.count() == 200 and df.where("target is null").count() == 0 and df.columns[-1] == "target", name
    a, b = (datasets.load(spark, "credit_risk", 100).collect() for _ in range(2))
    assert a == b
    runs = [comparison.Run("one", "d1", (0.5, 0.5, 0.5, 0.5, 0.5, 0.5), (0.6, 0.61, 0.62, 0.63, 0.64, 0.65), 1.0), comparison.Run("one", "d2", (0.5,), (0.5,), 2.0), comparison.Run("two", "d1", (0.5,), (0.4,), 3.0)]
    s = comparison.summary(runs)
    assert (s["one"]["wins"], s["one"]["ties"], s["one"]["significant"], s["two"]["losses"], s["two"]["coverage"]) == (1, 1, 1, 1, 0.5)
    assert "| one | 2 |" in comparison.report(runs)


def test_ranks_and_sums(spark):
    r = random.Random(3)
    rows = [(k, r.choice("ab") if k % 9 else None, r.randrange(40)) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    want = {i: k + 1 for k, (i, _, v) in enumerate(sorted(rows, key=lambda x: (x[2], x[0])))}
    assert {x.id: x["__rank"] for x in ordered(df, ["v", "id"]).collect()} == want
    by = {}
    for i, g, v in sorted(rows, key=lambda x: (x[2], x[0])):
        by[i] = sum(1 for j, h, u in rows if h == g and (u, j) <= (v, i))
    assert {x.id: x["__rank"] for x in ordered(df, ["v", "id"], group=["g"]).collect()} == by
    before = {x.id: x.s for x in sums_before(df, ["v", "id"], "v", "s").collect()}
    assert before == {i: sum(u for j, _, u in rows if (u, j) < (v, i)) for i, _, v in rows}
    assert ordered(df.limit(0), ["v"]).count() == 0
    folds = splits.time_folds(df, ["v", "id"], 4).groupBy("block").count().collect()
    assert sorted((x.block, x["count"]) for x in folds) == [(k, 100) for k in range(5)]
    assert splits.roc_auc(df.select(F.lit(1).alias("y"), "v"), "y", "v") is None
    y = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (0, None)], "y int, s double")
    assert splits.roc_auc(y, "y", "s") == 3.5 / 4
    with pytest.raises(ValueError):
        splits.time_folds(df.limit(2), ["v"], 5)


def test_kendall_and_medians_with_ties(spark):
    r = random.Random(4)
    rows = [(k % 5, r.randrange(6), r.choice([0.0, 1.0, 2.5, float("nan"), None])) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, a int, b double")
    ok = [(a, b) for _, a, b in rows if b is not None and not math.isnan(b)]
    s = x = y = 0
    for i, (a, b) in enumerate(ok):
        for c, d in ok[:i]:
            p, q = np.sign(a - c), np.sign(b - d)
            s, x, y = s + p * q, x + (p != 0), y + (q != 0)
    for block in (4096, 4):
        assert abs(scores.kendall(df, "a", "b", block) - s / math.sqrt(x * y)) < 1e-12
    assert scores.kendall(df.withColumn("b", F.lit(1.0)), "a", "b") is None
    parents = spark.range(6).select(F.col("id").cast("int").alias("k"))
    out = {z.k: z for z in RelationalEngine(["median", "nunique", "mean"], max_categorical=0).add_relationship("t", "k").fit_transform(parents, {"t": df}).collect()}
    for k in range(5):
        v = [b for g, _, b in rows if g == k and b is not None and not math.isnan(b)]
        assert (out[k].t_b_median, out[k].t_b_nunique) == (float(np.median(v)), len(set(v)))
    assert out[5].t_b_median is None
    none = RelationalEngine(["median", "nunique"], max_categorical=0).add_relationship("t", "k").fit_transform(parents.limit(1), {"t": df.select("k", F.lit(None).cast("double").alias("v"))}).first()
    assert none.t_v_median is None and none.t_v_nunique == 0


def test_kendall_grows_no_faster_than_sorting(spark):
    """30,000 distinct pairs in blocks of 32: compared pair by pair they took minutes.  Ties, weights and infinite values are exact."""
    n, r = 30_000, random.Random(5)
    rows = [(r.randrange(25), r.choice([r.randrange(n) * 1.0, 7.0])) for _ in range(n)] + [(24, float("inf")), (24, float("-inf")), (0, float("inf"))]
    df = spark.createDataFrame(rows, "a int, b double")
    began = time.monotonic()
    got = scores.kendall(df, "a", "b", 32)
    assert time.monotonic() - began < 60
    seen, discordant = [], 0
    for _, b in sorted(rows):
        discordant += len(seen) - bisect.bisect_right(seen, b)
        bisect.insort(seen, b)
    pairs = lambda v: sum(k * (k - 1) // 2 for k in Counter(v).values())
    every = len(rows) * (len(rows) - 1) // 2
    a, b = every - pairs(x for x, _ in rows), every - pairs(y for _, y in rows)
    assert got == (a + b - every + pairs(rows) - 2 * discordant) / math.sqrt(a * b)
    heavy = df.limit(50).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    assert abs(scores.kendall(heavy, "a", "b", 4) - scores.kendall(df.limit(50), "a", "b")) < 1e-12


def test_inversions_by_bits():
    r = np.random.default_rng(0)
    for n, high, scale in ((0, 1, 1), (1, 5, 1), (2, 2, 1), (40, 3, 1), (60, 10**12, 1), (60, 50, 1 << 32)):
        k, w = r.integers(0, high, n), r.integers(1, 9, n) * scale
        assert scores._inversions(k, w) == sum(int(w[i]) * int(w[j]) for j in range(n) for i in range(j) if k[i] > k[j])


def test_series_of_a_whole_table_in_chunks(spark, monkeypatch):
    from sparkfeat.operators import timeseries

    r = random.Random(1)
    v = [float(r.choice([0, 0, 1, 2, 2, 2, 5, -3])) if k % 11 else None for k in range(400)]
    df = spark.createDataFrame([(k, x, "u") for k, x in enumerate(v)], "t int, x double, e string")
    groups = [g for g in timeseries.GROUPS if g != "entropy"]
    want = TimeSeriesEngine(["t"], ["e"], groups).transform(df, ["x"]).drop("e").first().asDict()
    monkeypatch.setattr(timeseries, "CHUNK", 37)
    got = TimeSeriesEngine(["t"], None, groups).transform(df, ["x"]).first().asDict()
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k] or abs(got[k] - want[k]) < 1e-9, k
    cells = array_series(spark.createDataFrame([(1, v), (2, []), (3, None), (4, [1.0, float("inf"), 2.0])], "id int, x array<double>"), "x", groups)
    rows = {x.id: x.asDict() for x in cells.collect()}
    for k in want:
        assert rows[1][k] == want[k] or abs(rows[1][k] - want[k]) < 1e-9, k
    assert rows[2]["x_sum"] == 0 and rows[2]["x_mean"] is None and rows[3]["x_sum"] is None and rows[3]["x_length"] is None
    assert rows[4]["x_length"] == 3 and rows[4]["x_mean"] == 1.5
    assert TimeSeriesEngine(["t"], ["e"], ["fft"], only=["x_fft_coeff"]).transform(df, ["x"]).columns == ["e", *[f"x_fft_coeff_{k}" for k in range(1, 11)], "x_spectral_energy"]


def test_indicators_and_row_functions(spark):
    v = [3.0, 4.0, 2.0, 6.0, 5.0, 7.0]
    df = spark.createDataFrame([("u", k, x) for k, x in enumerate(v)], "e string, t int, p double")
    out = indicators(df, "p", ["t"], ["e"], windows=(3,), spans=(3,)).orderBy("t").collect()
    assert [x.p_sma_3 for x in out] == [None, None, 3.0, 4.0, 13 / 3, 6.0] and [x.p_up_next for x in out] == [1, 0, 1, 0, 1, None]
    w = [0.5**k for k in range(6)]
    assert abs(out[5].p_ema_3 - sum(a * b for a, b in zip(v[::-1], w)) / sum(w)) < 1e-12
    assert [x.s for x in parallel_apply(df, lambda r: r["p"] + r["t"], "s").orderBy("t").collect()] == [x + k for k, x in enumerate(v)]
    assert "p_sqrt" in parallel_transform(df, TabularEngine(include_transforms=["sqrt"]).fit(df.select("p")).features).columns


@pytest.mark.parametrize("classes", [False, True])
def test_models_are_fitted_on_all_cores(spark, monkeypatch, classes):
    """Files of one row group give one partition with rows; forests are fitted on as many as there are cores, each a fair share."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    kind, seen = RandomForestClassifier if classes else RandomForestRegressor, []
    fit = kind.fit

    def watched(self, d, *more):
        seen.append([n for n in d.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n])
        return fit(self, d, *more)

    monkeypatch.setattr(kind, "fit", watched)
    df = spark.range(2000).select("id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000).alias(c) for k, c in enumerate("ab")])
    df = df.withColumn("y", F.col("a") * F.col("b")).withColumn("y", (F.col("y") > 0.25).cast("int") if classes else F.col("y")).withColumn("p", F.col("a") * F.col("b")).coalesce(1)
    keep, gain = scores.gate(df, ["a", "b"], ["a", "b", "p"], "y", "id", splits=2, trees=3)
    assert keep and gain > 0
    assert (keep, gain) == scores.gate(df.orderBy(F.desc("a")), ["a", "b"], ["a", "b", "p"], "y", "id", splits=2, trees=3)
    imp = scores.importances(df, ["a", "b", "p"], "y", trees=3)
    assert imp["p"] > imp["a"]
    cores = spark.sparkContext.defaultParallelism
    assert len(seen) == 9 and all(len(n) == cores and max(n) < 2 * sum(n) / cores for n in seen), seen


def test_indicators_after_a_value_of_zero(spark, tmp_path):
    """The deviation is no number while a change from zero lies in its rows, as in the SQL, and a number before and after."""
    v = [3.0, 4.0, 0.0, 6.0, 0.0, 0.0, 5.0, -7.0, 2.0, 8.0, 1.0, 9.0, 4.0, 4.5, 7.0, -0.0, -1.0]
    rows = [(2 * k + u, u, datetime(2024, 1, 1 + k), x + u) for k, x in enumerate(v) for u in (0, 1)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = qs.QUERIES["ts_indicators"](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = db.execute(f"SELECT {', '.join(out.columns)} FROM ({qs.SQL['ts_indicators']})").fetchall()
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    vol = [r.value_vol_5 for r in out.where("event_id % 2 = 0").orderBy("event_id").collect()]
    assert [x is not None and not math.isnan(x) for x in vol] == [False] * 11 + [True] * 5 + [False]


def test_texts_and_encodings(spark):
    counted = lambda xs: [{"noun": len(x.split()), "verb": 1} for x in xs]
    t = spark.createDataFrame([(1, "word " * 5000), (2, "x" * 35), (3, None)], "id int, s string")
    got = {r.id: r for r in text.parts_of_speech(t, "s", counted, piece=10).collect()}
    assert got[1].s_pos_noun_ratio > 0.6 and got[2].s_pos_noun_ratio == 0.5
    ent = {r.id: r.s_ner_total for r in text.named_entities(t, "s", lambda xs: [{"person": x.count("word")} for x in xs], piece=7).collect()}
    assert ent == {1: 5000, 2: 0, 3: 0}
    rows = [(k, " ".join(random.Random(k).choices([f"term{j}" for j in range(30)], k=12))) for k in range(60)]
    df = spark.createDataFrame([*rows, (99, "")], "id int, s string")
    w = text.tfidf(df, "id", "s").collect()
    terms = sorted({x.term for x in w})
    a = np.zeros((60, len(terms)))
    for x in w:
        a[x.id, terms.index(x.term)] = x.weight
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    got = {x.id: [x[f"s_tfidf_{j}"] for j in range(3)] for x in text.tfidf_svd(df, "id", "s", 3, rounds=30).collect()}
    p = np.array([got[k] for k in range(60)])
    assert set(got) == set(range(60)) and np.allclose(np.sqrt((p**2).sum(axis=0)), s[:3], rtol=1e-6)
    assert np.allclose(np.abs(p.T @ (a @ vt[:3].T)), np.diag(s[:3] ** 2), atol=1e-4)
    train, test = ordinal_encode(spark.createDataFrame([("b",), ("a",), (None,)], "c string"), spark.createDataFrame([("a",), ("z",), (None,)], "c string"), ["c"])
    assert [r.c for r in train.collect()] == [1, 0, 2] and [r.c for r in test.collect()] == [0, 3, 2]


def test_sinks_stores_and_command_line(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, "a", None), (2, 'q"x', 1.5)], "i int, s string, v double")
    one = str(tmp_path / "out" / "one.json")
    io.write(df, one, single_file=True)
    assert json.loads(open(one).read()) == [{"i": 1, "s": "a", "v": None}, {"i": 2, "s": 'q"x', "v": 1.5}]
    io.write(df.limit(0), one, single_file=True)
    assert json.loads(open(one).read()) == []
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "notes.txt").write_text("keep")
    with pytest.raises(ValueError):
        io.write(df, str(tmp_path / "mine"), "csv")
    with pytest.raises(ValueError):
        io.with_target(df, df, "v", ["i"])
    with pytest.warns(UserWarning):
        assert io.head_slice(df, 1, ["i"]).first().i == 1
    with FeatureStore(spark, str(tmp_path / "store")) as s:
        s.save(df.withColumn("t", F.current_timestamp()), "v", ["i"], "t", ttl_days=0)
        s.materialise("v")
        assert s.online_dict(spark.createDataFrame([(2,)], "i int"), "v")["s"] == ['q"x'] and s.schema("v")["type"] == "struct"
        s.close()
    src = str(tmp_path / "t.parquet")
    frame(spark).drop("c").write.parquet(src)
    out = str(tmp_path / "o.parquet")
    args = ["transform", "--input", src, "--output", out, "--target", "y", "--max-features", "6", "--selection-methods", "correlation", "f_test", "--correlation-threshold", "0.9", "--gate-n-jobs", "2", "--task-description", "find y", "--order-by", "id", "--limit", "200", "--verbose", "--include-target"]
    assert cli.main(args) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["status"] == "ok" and "y" in said["columns"] and any("200" in w for w in said["warnings"])
    assert cli.main([*args, "--gate-n-jobs", "0"]) == 2 and cli.main([*args[:-1], "--use-gate"]) == 2
    assert cli.main(["info"]) == 0
