"""The pipeline as a Spark ML estimator: fits in ``pyspark.ml.Pipeline``, its model is saved and loaded with the plan alone."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import RelationalEngine, Relationship
from ..operators.scores import FeatureSelector
from ..sources.shared import Files
from ..spec import FeatureSet
from .pipeline import AutoFeatureEngineer


class AutoFeatureEstimator(Estimator):
    """``AutoFeatureEngineer`` with a label and, for the relational engine, the related tables."""

    def __init__(self, label: str | None = None, related: dict[str, DataFrame] | None = None, **params) -> None:
        super().__init__()
        self.label, self.related, self.engineer_params = label, related, params
        AutoFeatureEngineer(**params)

    def _fit(self, dataset: DataFrame) -> "AutoFeatureModel":
        return AutoFeatureModel(AutoFeatureEngineer(**self.engineer_params).fit(dataset, self.label, self.related))


class FeatureEngineerTransformer(AutoFeatureEstimator):
    """One engine as a stage: its features are added, nothing is selected."""

    def __init__(self, engine: str = "tabular", label: str | None = None, related: dict[str, DataFrame] | None = None, **engine_params) -> None:
        how = {} if not engine_params else {engine: engine_params}
        if engine == "relational":
            how = {"relational": engine_params.get("engine_object") or RelationalEngine(**engine_params)}
        super().__init__(label, related, engines=(engine,), **how)


class AutoFeatureModel(Model, MLWritable, MLReadable):
    def __init__(self, engineer: AutoFeatureEngineer | None = None) -> None:
        super().__init__()
        self.engineer = engineer

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.engineer.transform(dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> "_Reader":
        return _Reader()


def _tables(engine, name: str) -> dict[str, DataFrame]:
    """The small tables that a fitted engine joins with."""
    if name == "tabular":
        return {f"lookup {k}": means for k, (_, means, _) in engine.lookups.items()}
    if name == "text":
        return {f"codes {c}": d for c, d in engine.codes.items()}
    if name == "relational":
        return {f"groups {c}": d for c, d in (engine._groups or {}).items()}
    return {}


def _state(engine, name: str) -> dict:
    out = {"name": name, "features": json.loads(engine.features.to_json()) if hasattr(engine, "features") else []}
    if name == "tabular":
        out |= {"numeric": engine.numeric, "encoded": engine.encoded, "keep_original": engine.keep_original, "lookups": {k: [c, overall] for k, (c, _, overall) in engine.lookups.items()}}
    elif name == "text":
        out |= {"texts": engine.texts, "drop": engine.drop, "codes": list(engine.codes)}
    elif name == "relational":
        out |= {"functions": engine.functions, "stats": engine.stats, "max_categorical": engine.max_categorical, "max_numeric": engine.max_numeric, "relationships": [[r.parent, r.child_key, r.parent_key, list(r.order_cols)] for r in engine.relationships], "groups": list(engine._groups or {})}
    elif name == "timeseries":
        out |= {"columns": engine.columns}
    return out


class _Writer(MLWriter):
    def __init__(self, model: AutoFeatureModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, e = self.sparkSession, self.model.engineer
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        states, tables = [], 0
        for name, engine in e.fitted:
            state = _state(engine, name)
            state["tables"] = {}
            for key, df in _tables(engine, name).items():
                state["tables"][key] = f"table{tables}"
                df.write.mode("overwrite").parquet(f"{path}/tables/table{tables}")
                tables += 1
            states.append(state)
        s = e.selector
        params = {k: v for k, v in e.params.items() if k not in ("relational", "semantic")}
        plan = {"params": params, "label": e.label, "originals": e.originals, "engines": states, "selected": s.selected if s else None, "scores": s.scores if s else None, "gate": e.gate_result}
        Files(spark).write(f"{path}/plan.json", json.dumps(plan))


class _Reader(MLReader):
    def load(self, path: str, related: dict[str, DataFrame] | None = None) -> AutoFeatureModel:
        """The saved model; the relational engine's related tables are given again."""
        spark: SparkSession = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        plan = json.loads(Files(spark).read(f"{path}/plan.json"))
        e = AutoFeatureEngineer(**plan["params"])
        e.label, e.originals, e.related = plan["label"], plan["originals"], related or {}
        e.gate_result = tuple(plan["gate"]) if plan["gate"] else None
        for st in plan["engines"]:
            name = st["name"]
            at = lambda key: spark.read.parquet(f"{path}/tables/{st['tables'][key]}")  # noqa: B023, E731
            engine = e._make(name)
            if name == "relational":
                engine = RelationalEngine(st["functions"], st["stats"], st["max_categorical"], st["max_numeric"])
                engine.relationships = [Relationship(p, c, k, tuple(o)) for p, c, k, o in st["relationships"]]
                engine._groups = {c: at(f"groups {c}") for c in st["groups"]} or None
            else:
                engine.features = FeatureSet.from_json(json.dumps(st["features"]))
            if name == "tabular":
                engine.numeric, engine.encoded, engine.keep_original = st["numeric"], st["encoded"], st["keep_original"]
                engine.lookups = {k: (c, at(f"lookup {k}"), overall) for k, (c, overall) in st["lookups"].items()}
            elif name == "text":
                engine.texts, engine.drop, engine.codes = st["texts"], st["drop"], {c: at(f"codes {c}") for c in st["codes"]}
            elif name == "timeseries":
                engine.columns = st["columns"]
            e.fitted.append((name, engine))
        if plan["selected"] is not None:
            e.selector = FeatureSelector(tuple(plan["params"]["selection_methods"]))
            e.selector.scores = plan["scores"]
            e.selector.set_selected_features(plan["selected"])
        model = AutoFeatureModel(e)
        model._resetUid(meta["uid"])
        return model
