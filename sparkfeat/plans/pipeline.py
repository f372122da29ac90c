"""The automatic pipeline: engines, selection, and a gate that gives up features that do not help."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import q
from ..leakage import guard
from ..operators.relational import RelationalEngine
from ..operators.scores import METHODS, FeatureSelector, gate
from ..operators.tabular import TabularEngine
from ..operators.text import TextEngine
from ..operators.timeseries import TimeSeriesEngine
from ..semantic import SemanticEngine
from ..spec import FeatureSet, FeatureType, columns_of

ENGINES = ("tabular", "timeseries", "relational", "text", "semantic")


class SeriesFeatures:
    """The time-series engine within a pipeline: every row gets the features of its entity's series."""

    def __init__(self, order_cols: list[str], entity_cols: list[str] | None = None, columns: list[str] | None = None, **how) -> None:
        self.engine = TimeSeriesEngine(order_cols, entity_cols, **how)
        self.given, self.columns, self.features = columns, [], FeatureSet()

    def fit(self, df: DataFrame, label: str | None = None) -> "SeriesFeatures":
        skip = {*self.engine.order, *self.engine.entity, *([label] if label else [])}
        self.columns = [c for c in (self.given or columns_of(df, FeatureType.NUMERIC)) if c not in skip]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.engine.broadcast_to(df, self.columns) if self.columns else df


class AutoFeatureEngineer:
    """``fit`` learns a plan, ``transform`` adds the selected columns in one lazy plan.

    Every engine sees the original columns; only columns that are new are added.  Parameters of the engines:
    ``tabular``, ``text`` and ``semantic`` are dicts of theirs, ``timeseries`` one with order_cols at least,
    ``relational`` an engine with its relationships.
    """

    def __init__(
        self,
        engines: tuple[str, ...] = ("tabular",),
        max_features: int | None = None,
        selection_methods: tuple[str, ...] = ("correlation", "f_test"),
        correlation_threshold: float = 0.95,
        leakage: str = "warn",
        relational: RelationalEngine | None = None,
        tabular: dict | None = None,
        timeseries: dict | None = None,
        text: dict | None = None,
        semantic: dict | None = None,
        use_gate: bool = False,
        gate_key: str | None = None,
        gate_splits: int = 5,
        gate_trees: int = 50,
        refine: bool = False,
    ) -> None:
        self.params = {k: v for k, v in locals().items() if k != "self"}
        self._validate(self.params)
        self.fitted: list[tuple[str, object]] = []
        self.selector: FeatureSelector | None = None
        self.gate_result: tuple[bool, float] | None = None

    @staticmethod
    def _validate(p: dict) -> None:
        if not isinstance(p["engines"], (list, tuple)) or not p["engines"] or set(p["engines"]) - set(ENGINES):
            raise ValueError(f"engines is a non-empty list of {ENGINES}")
        if p["max_features"] is not None and (isinstance(p["max_features"], bool) or p["max_features"] <= 0):
            raise ValueError("max_features must be positive")
        if p["leakage"] not in ("off", "warn", "raise"):
            raise ValueError("leakage is off, warn or raise")
        if not 0 < p["correlation_threshold"] <= 1:
            raise ValueError("correlation_threshold lies between 0 and 1")
        if p["use_gate"] and not p["gate_key"]:
            raise ValueError("the gate needs gate_key, a column that names rows")
        if "timeseries" in p["engines"] and not (p["timeseries"] or {}).get("order_cols"):
            raise ValueError("the timeseries engine needs its order_cols")
        if not p["selection_methods"]:
            raise ValueError(f"selection_methods is a non-empty list of {METHODS}")
        for k in ("gate_splits", "gate_trees"):
            if isinstance(p[k], bool) or p[k] < 1:
                raise ValueError(f"{k} must be positive")
        FeatureSelector(tuple(p["selection_methods"]))

    def get_params(self) -> dict:
        return dict(self.params)

    def set_params(self, **new) -> "AutoFeatureEngineer":
        """All of the new parameters or, if one is wrong, none; what was fitted with others is forgotten."""
        if unknown := set(new) - set(self.params):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        p = self.params | new
        self._validate(p)
        if p != self.params:
            self.fitted, self.selector, self.gate_result = [], None, None
        self.params = p
        return self

    def _make(self, name: str):
        p = self.params
        if name == "tabular":
            return TabularEngine(**(p["tabular"] or {}))
        if name == "timeseries":
            return SeriesFeatures(**p["timeseries"])
        if name == "text":
            return TextEngine(**({"drop_original": False} | (p["text"] or {})))
        if name == "semantic":
            return SemanticEngine(**(p["semantic"] or {}))
        return p["relational"] or RelationalEngine()

    def fit(self, df: DataFrame, label: str | None = None, related: dict[str, DataFrame] | None = None, apply_selection: bool = True) -> "AutoFeatureEngineer":
        p = self.params
        guard([c for c in df.columns if c != label], label, p["leakage"])
        self.fitted, self.selector, self.gate_result, self.label, self.related = [], None, None, label, related or {}
        self.originals = [c for c in df.columns if c != label]
        x = df.select(*[F.col(q(c)) for c in self.originals])
        for name in p["engines"]:
            e = self._make(name)
            if name == "relational":
                e.fit(x, self.related)
            elif name == "text":
                e.fit(x)
            else:
                e.fit(df, label)
            self.fitted.append((name, e))
        if apply_selection and label is not None and p["max_features"]:
            full = self._engineer(df).persist()
            s = FeatureSelector(tuple(p["selection_methods"]), p["max_features"], p["correlation_threshold"], original_features=self.originals, refine=p["refine"])
            self.selector = s.fit(full, label)
            if p["use_gate"]:
                self.gate_result = gate(full, self.originals, s.selected, label, p["gate_key"], p["gate_splits"], p["gate_trees"])
                if not self.gate_result[0]:
                    s.set_selected_features(self.originals)
            full.unpersist()
        return self

    def _engineer(self, df: DataFrame) -> DataFrame:
        out = df
        for name, e in self.fitted:
            out = e.transform(out, self.related) if name == "relational" else e.transform(out)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._engineer(df)
        if self.selector is None:
            return out
        keep = set(self.selector.selected) | ({self.label} if self.label in df.columns else set())
        return out.select(*[F.col(q(c)) for c in out.columns if c in keep])

    def fit_transform(self, df: DataFrame, label: str | None = None, **how) -> DataFrame:
        return self.fit(df, label, **how).transform(df)

    def features(self) -> FeatureSet:
        specs = [f for _, e in self.fitted for f in getattr(e, "features", ())]
        scores = self.selector.scores if self.selector else {}
        return FeatureSet(specs).with_importances(scores)

    @property
    def feature_importances(self) -> dict[str, float]:
        return self.selector.feature_importances if self.selector else {}

    def set_selected_features(self, names: list[str]) -> None:
        if self.selector is None:
            self.selector = FeatureSelector()
        self.selector.set_selected_features(names)

    def explain(self) -> dict[str, str]:
        return self.features().explanations()

    def code(self) -> dict[str, str]:
        return {f.name: f.code for f in self.features()}
