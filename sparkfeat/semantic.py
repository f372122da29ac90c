"""Suggested features: a language model's answers as data, compiled and validated, never executed.

``MockLLM`` answers offline and deterministically; any object with ``complete(prompt) -> str`` that
returns the same JSON takes its place.
"""

from __future__ import annotations

import json
import re
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.compiler import CompileError, compile_code, validate
from .functions.expr import q
from .rules import TransformRule
from .spec import FeatureOrigin, FeatureSet, FeatureSpec, FeatureType, columns_of

#: What a domain's prompts ask for: name, the words that name its inputs, the code over them.
DOMAINS: dict[str, list[tuple[str, tuple[str, ...], str]]] = {
    "healthcare": [
        ("body_mass_index", ("weight", "height"), "result = df['{0}'] / (df['{1}'] * df['{1}'] + 1e-8)"),
        ("pulse_pressure", ("systolic", "diastolic"), "result = df['{0}'] - df['{1}']"),
        ("lipid_ratio", ("cholesterol", "hdl"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
        ("glucose_per_age", ("glucose", "age"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
    ],
    "finance": [
        ("debt_to_income", ("debt", "income"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
        ("utilisation", ("balance", "limit"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
        ("savings_rate", ("savings", "income"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
        ("log_income", ("income",), "result = np.log1p(np.abs(df['{0}']))"),
    ],
    "retail": [
        ("basket_value", ("price", "quantity"), "result = df['{0}'] * df['{1}']"),
        ("discount_share", ("discount", "price"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
        ("orders_per_day", ("orders", "days"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
        ("votes_per_rating", ("votes", "rating"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
    ],
    "telecom": [
        ("charge_per_month", ("charges", "tenure"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
        ("tickets_per_month", ("tickets", "tenure"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
        ("usage_per_charge", ("usage", "charges"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
        ("minutes_per_call", ("minutes", "calls"), "result = df['{0}'] / (df['{1}'] + 1e-8)"),
    ],
}


def domain_features(df: DataFrame, domain: str) -> list[dict]:
    """The domain's features whose inputs name columns of ``df``, as a reply of a language model would list them."""
    if domain not in DOMAINS:
        raise ValueError(f"domain is one of {sorted(DOMAINS)}")
    cols, out = columns_of(df, FeatureType.NUMERIC), []
    for name, words, code in DOMAINS[domain]:
        found = [next((c for c in cols if w in c.lower()), None) for w in words]
        if all(found) and len(set(found)) == len(found):
            out.append({"name": name, "code": code.format(*found), "source_columns": found, "explanation": f"{name.replace('_', ' ')} of {' and '.join(found)}"})
    return out


class LLM(Protocol):
    def complete(self, prompt: str) -> str: ...


class MockLLM:
    """Ratio, product, normalised and z-score of the first three columns that the prompt lists."""

    models = ("mock-small", "mock-large")

    def complete(self, prompt: str) -> str:
        cols = json.loads(prompt[prompt.index("[") : prompt.index("]") + 1])[:3]
        out = []
        if len(cols) >= 2:
            a, b = cols[:2]
            out.append({"name": f"{a}_{b}_ratio", "code": f"result = df['{a}'] / (df['{b}'] + 1e-8)", "source_columns": [a, b], "explanation": f"{a} relative to {b}"})
            out.append({"name": f"{a}_{b}_product", "code": f"result = df['{a}'] * df['{b}']", "source_columns": [a, b], "explanation": f"{a} and {b} together"})
        if len(cols) >= 3:
            a, c = cols[0], cols[2]
            out.append({"name": f"{a}_normalized_by_{c}", "code": f"result = (df['{a}'] - df['{a}'].mean()) / (df['{c}'] + 1e-8)", "source_columns": [a, c], "explanation": f"{a} about its mean, by {c}"})
        out += [{"name": f"{c}_zscore", "code": f"result = (df['{c}'] - df['{c}'].mean()) / (df['{c}'].std() + 1e-8)", "source_columns": [c], "explanation": f"{c} in standard deviations"} for c in cols[:1]]
        return json.dumps({"features": out})


def parse(reply: str) -> dict:
    """The JSON object in a reply, fenced or bare; empty if there is none."""
    m = re.search(r"\{.*\}", re.sub(r"```\w*", "", reply), re.DOTALL)
    try:
        return json.loads(m.group()) if m else {}
    except json.JSONDecodeError:
        return {}


class SemanticEngine:
    """Suggestions of the domain's own features and of the model; what does not compile is kept in ``rejected`` with its reason."""

    def __init__(self, llm: LLM | None = None, max_suggestions: int = 20, domain: str | None = None, task: str | None = None) -> None:
        if domain is not None and domain not in DOMAINS:
            raise ValueError(f"domain is one of {sorted(DOMAINS)}")
        self.task = task
        self.llm, self.max, self.domain, self.features, self.rejected = llm or MockLLM(), max_suggestions, domain, FeatureSet(), {}

    def fit(self, df: DataFrame, label: str | None = None, descriptions: dict[str, str] | None = None) -> "SemanticEngine":
        cols = columns_of(df, FeatureType.NUMERIC, [label] if label else [])
        hints = "; ".join(f"{n}: {c}" for n, _, c in DOMAINS[self.domain]) if self.domain else "none"
        prompt = f"Suggest features as JSON from columns {json.dumps(cols)}; notes {json.dumps(descriptions or {})[1:-1]}; task {self.task}; domain {self.domain}, as in {hints}"
        specs = []
        offered = (domain_features(df, self.domain) if self.domain else []) + parse(self.llm.complete(prompt)).get("features", [])
        for f in offered[: self.max]:
            try:
                sql, source = compile_code(f["code"], df)
                specs.append(FeatureSpec(f["name"], sql, FeatureOrigin.LLM_GENERATED, source_columns=tuple(source), transformation=f["code"], explanation=f.get("explanation", "")))
            except (CompileError, KeyError) as e:
                self.rejected[f.get("name", "?")] = str(e)
        self.features = FeatureSet(specs)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.features.compute_all(df)


def generate_code(df: DataFrame, description: str) -> dict:
    """{code, valid, error, warnings} for a request that names columns: ratio, product, difference or log of them."""
    cols = [c for c in columns_of(df, FeatureType.NUMERIC) if re.search(rf"\b{re.escape(c)}\b", description)]
    word = next((w for w in ("ratio", "product", "difference", "log") if w in description.lower()), None)
    if not cols or word is None:
        return {"code": "", "valid": False, "error": "no known column or operation is named", "warnings": []}
    a, b = cols[0], cols[-1]
    code = {"ratio": f"result = df['{a}'] / (df['{b}'] + 1e-8)", "product": f"result = df['{a}'] * df['{b}']", "difference": f"result = df['{a}'] - df['{b}']", "log": f"result = np.log1p(np.abs(df['{a}']))"}[word]
    return {"code": code} | validate(code, df)


def generate_rule(df: DataFrame, name: str, description: str, tags: list[str] | None = None) -> TransformRule:
    got = generate_code(df, description)
    if not got["valid"]:
        raise ValueError(got["error"])
    _, source = compile_code(got["code"], df)
    return TransformRule(name, got["code"], source, description, tags=tags or [])


def standardise(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """``column`` with its values mapped; values without a mapping and nulls stay."""
    c = F.col(q(column))
    if not mapping:
        return df
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    new: Column = F.coalesce(F.try_element_at(table, c.cast("string")), c.cast("string"))
    return df.select(*[new.alias(x) if x == column else F.col(q(x)) for x in df.columns])


def frequent_values(df: DataFrame, column: str, most: int = 50) -> list[str]:
    rows = df.where(F.col(q(column)).isNotNull()).groupBy(F.col(q(column)).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(most).collect()
    return [r["v"] for r in rows]


def checked_mapping(reply: str, values: list[str]) -> dict[str, str]:
    """A reply's mapping or groups, as far as they name existing values whatever their case."""
    d = parse(reply)
    pairs = dict(d.get("mapping", {})) | {v: g for g, vs in d.get("groups", {}).items() for v in vs}
    known = {v.lower(): v for v in values}
    return {known[str(k).lower()]: str(v) for k, v in pairs.items() if str(k).lower() in known}


def explain_feature(f: FeatureSpec, llm: LLM | None = None) -> str:
    """A sentence about a feature: the model's if it gives one, else its own, else what it is made of."""
    if llm is not None:
        said = llm.complete(f"Explain in one sentence the column {f.name}, which is {f.code}, from columns {json.dumps(list(f.source_columns))}")
        if said.strip() and not parse(said):
            return said.strip()
    return f.explanation or f"made of {', '.join(f.source_columns)}"


def standardise_with(df: DataFrame, column: str, llm: LLM, most: int = 50) -> DataFrame:
    """``column`` with the values that the model maps, asked about the ``most`` frequent ones; what it invents is ignored."""
    values = frequent_values(df, column, most)
    reply = llm.complete(f"Group values that mean the same, as JSON with mapping or groups: {json.dumps(values)}")
    return standardise(df, column, checked_mapping(reply, values))


def report(features: FeatureSet, df: DataFrame | None = None) -> str:
    """Markdown: each feature with its explanation, SQL and, over ``df``, its count, mean and deviation."""
    lines = ["# Features", ""]
    stats = {}
    names = [f.name for f in features if df is not None and f.name in df.columns and FeatureType.of(df.schema[f.name].dataType) == FeatureType.NUMERIC]
    if names:
        r = df.agg(*[x for k, c in enumerate(names) for x in (F.count(q(c)).alias(f"n{k}"), F.avg(q(c)).alias(f"m{k}"), F.stddev_samp(q(c)).alias(f"s{k}"))]).first()
        stats = {c: (r[f"n{k}"], r[f"m{k}"], r[f"s{k}"]) for k, c in enumerate(names)}
    for f in features:
        lines += [f"## {f.name}", "", f.explanation or f"from {', '.join(f.source_columns)}", "", f"`{f.code}`", ""]
        if f.name in stats:
            lines += ["count {}, mean {}, deviation {}".format(*stats[f.name]), ""]
    return "\n".join(lines)
