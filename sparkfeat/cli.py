"""Command line: info, transform, explain.  JSON on standard output; exit codes 0, 1, 2 and 130."""

from __future__ import annotations

import argparse
import json
import sys
import warnings

from pyspark.sql import SparkSession

from .llm_clients import BACKENDS
from .operators.scores import METHODS
from .plans.pipeline import ENGINES, AutoFeatureEngineer
from .sources import io

OPTIONS = ("engines", "max_features", "selection_methods", "correlation_threshold", "leakage", "use_gate", "gate_key", "gate_splits", "gate_trees", "timeseries", "tabular", "text", "semantic", "refine")
FLAGS = ("engines", "max_features", "selection_methods", "correlation_threshold", "leakage", "use_gate", "gate_key")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkfeat")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    for name in ("transform", "explain"):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True)
        s.add_argument("--input-format")
        s.add_argument("--target")
        s.add_argument("--config")
        s.add_argument("--engines", nargs="+", choices=ENGINES)
        s.add_argument("--max-features", type=int)
        s.add_argument("--selection-methods", nargs="+", choices=METHODS)
        s.add_argument("--correlation-threshold", type=float)
        s.add_argument("--leakage", choices=("off", "warn", "raise"))
        s.add_argument("--use-gate", action="store_true", default=None)
        s.add_argument("--gate-key")
        s.add_argument("--gate-n-jobs", type=int, help="models that the gate may fit at a time; Spark shares its executors, so any number gives the same result")
        s.add_argument("--task-description", help="what the label means, for suggested features")
        s.add_argument("--limit", type=int)
        s.add_argument("--order-by", nargs="+", help="columns that decide which rows the limit keeps")
        s.add_argument("--verbose", action="store_true")
        if name == "transform":
            s.add_argument("--output", required=True)
            s.add_argument("--output-format")
            s.add_argument("--include-target", action="store_true")
            s.add_argument("--single-file", action="store_true")
    return p


def settings(a: argparse.Namespace) -> dict:
    """Flags before the configuration file before defaults; unknown keys are refused."""
    conf = {}
    if a.config:
        with open(a.config) as f:
            conf = json.load(f)
        if not isinstance(conf, dict) or (unknown := set(conf) - set(OPTIONS)):
            raise ValueError(f"unknown configuration keys: {sorted(unknown) if isinstance(conf, dict) else conf}")
    flags = {k: getattr(a, k) for k in FLAGS if getattr(a, k, None) is not None}
    if getattr(a, "task_description", None):
        flags["semantic"] = conf.get("semantic", {}) | {"task": a.task_description}
    if (n := getattr(a, "gate_n_jobs", None)) is not None and n != -1 and n < 1:
        raise ValueError("gate-n-jobs is -1 or positive")
    return conf | flags


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0) and 2
    try:
        if a.command == "info":
            print(json.dumps({"status": "ok", "engines": list(ENGINES), "selection_methods": list(METHODS), "backends": list(BACKENDS), "formats": sorted(set(io.FORMATS.values()))}))
            return 0
        spark = SparkSession.builder.appName("sparkfeat").getOrCreate()
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            say = (lambda *x: print(*x, file=sys.stderr)) if a.verbose else lambda *x: None
            df = io.read(spark, a.input, a.input_format, a.limit, order_by=a.order_by)
            say("read", a.input, len(df.columns), "columns")
            if a.target:
                io.split_label(df, a.target)
            eng = AutoFeatureEngineer(**settings(a))
            if eng.params["max_features"] and not a.target:
                raise ValueError("selection needs --target")
            eng.fit(df, a.target, apply_selection=a.command == "transform")
            say("fitted", ", ".join(eng.params["engines"]))
            said = [str(w.message) for w in seen if issubclass(w.category, UserWarning)]
            if a.command == "explain":
                print(json.dumps({"status": "ok", "features": [f.to_dict() for f in eng.features()], "warnings": said}))
                return 0
            if a.target and a.target in {f.name for f in eng.features()}:
                raise ValueError(f"a feature has the target's name {a.target!r}")
            out = eng.transform(df)
            if a.target and not a.include_target:
                out = out.drop(a.target)
            io.write(out, a.output, a.output_format, a.single_file)
            print(json.dumps({"status": "ok", "columns": out.columns, "output": a.output, "warnings": said}))
        return 0
    except KeyboardInterrupt:
        return 130
    except (ValueError, KeyError, OSError) as e:
        print(json.dumps({"status": "error", "error": str(e)}), file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001 - the last resort of a command
        print(json.dumps({"status": "error", "error": str(e).split("\n")[0]}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
