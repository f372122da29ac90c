"""Feature code as a whitelisted Python expression compiled to Spark SQL text; nothing is executed.

``result = <expression>`` over ``df['x']``, numbers and strings, arithmetic, comparisons, ``& | ~``, the
listed ``np`` functions and methods.  Aggregates such as ``df['x'].mean()`` become literals taken from
the frame the code is fitted on.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import FeatureType
from .expr import TRANSFORMS, finite, num, q

BIN = {ast.Add: "({a} + {b})", ast.Sub: "({a} - {b})", ast.Mult: "({a} * {b})", ast.Div: "try_divide({a}, {b})", ast.Mod: "try_mod({a}, {b})", ast.Pow: "pow({a}, {b})", ast.BitAnd: "({a} and {b})", ast.BitOr: "({a} or {b})"}
CMP = {ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<=", ast.Eq: "=", ast.NotEq: "<>"}
NP = {"log1p": "log1p({0})", "log": "ln({0})", "log10": "log10({0})", "sqrt": "if({0} < 0, null, sqrt({0}))", "abs": "abs({0})", "exp": "exp({0})", "sin": "sin({0})", "cos": "cos({0})", "tanh": "tanh({0})", "sign": "signum({0})", "where": "if({0}, {1}, {2})", "clip": "if({0} is null, null, least(greatest({0}, {1}), {2}))", "minimum": "least({0}, {1})", "maximum": "greatest({0}, {1})", "isnan": "({0} is null)"}
METHOD = {"fillna": "coalesce({0}, {1})", "abs": "abs({0})", "clip": NP["clip"], "isna": "({0} is null)", "isnull": "({0} is null)", "notna": "({0} is not null)"}
AGG = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "median": F.median, "sum": F.sum}
STR = {"len": "length({0})", "lower": "lower({0})", "upper": "upper({0})", "strip": "trim({0})", "contains": "contains({0}, {1})", "count": "(size(split({0}, concat('\\\\Q', {1}, '\\\\E'))) - 1)"}


class CompileError(ValueError):
    pass


class _Compiler:
    def __init__(self, df: DataFrame) -> None:
        self.df, self.text = df, {f.name for f in df.schema.fields if FeatureType.of(f.dataType) == FeatureType.CATEGORICAL}
        self.source: list[str] = []

    def column(self, name: str) -> str:
        if name not in self.df.columns:
            raise CompileError(f"unknown column {name!r}")
        if name not in self.source:
            self.source.append(name)
        kind = FeatureType.of(self.df.schema[name].dataType)
        return num(name) if kind == FeatureType.NUMERIC else f"cast({q(name)} as int)" if kind == FeatureType.BOOLEAN else q(name)

    def visit(self, n: ast.AST) -> str:
        if isinstance(n, ast.Constant):
            if isinstance(n.value, bool):
                return str(n.value).lower()
            if isinstance(n.value, (int, float)):
                return f"{float(n.value)!r}D"
            if isinstance(n.value, str):
                return "'" + n.value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == "df" and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str):
            return self.column(n.slice.value)
        if isinstance(n, ast.BinOp) and type(n.op) in BIN:
            return BIN[type(n.op)].format(a=self.visit(n.left), b=self.visit(n.right))
        if isinstance(n, ast.UnaryOp):
            v = self.visit(n.operand)
            if isinstance(n.op, ast.USub):
                return f"(-{v})"
            if isinstance(n.op, (ast.Not, ast.Invert)):
                return f"(not {v})"
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in CMP:
            return f"({self.visit(n.left)} {CMP[type(n.ops[0])]} {self.visit(n.comparators[0])})"
        if isinstance(n, ast.IfExp):
            return f"if({self.visit(n.test)}, {self.visit(n.body)}, {self.visit(n.orelse)})"
        if isinstance(n, ast.Call) and not n.keywords:
            return self.call(n)
        raise CompileError(f"not allowed: {ast.unparse(n)[:80]}")

    def call(self, n: ast.Call) -> str:
        f = n.func
        if isinstance(f, ast.Name) and f.id in TRANSFORMS and len(n.args) == 1:
            return TRANSFORMS[f.id][1].format(x=self.visit(n.args[0]))
        if not isinstance(f, ast.Attribute):
            raise CompileError(f"not allowed: {ast.unparse(n)[:80]}")
        if isinstance(f.value, ast.Name) and f.value.id == "np":
            if f.attr not in NP:
                raise CompileError(f"np.{f.attr} is not allowed")
            return self.fill(NP[f.attr], [self.visit(a) for a in n.args])
        if isinstance(f.value, ast.Attribute) and f.value.attr == "str" and f.attr in STR:
            return self.fill(STR[f.attr], [f"cast({self.visit(f.value.value)} as string)", *map(self.visit, n.args)])
        if f.attr in AGG and not n.args:
            v = self.df.agg(AGG[f.attr](F.expr(self.visit(f.value)))).first()[0]
            return "cast(null as double)" if v is None else f"{float(v)!r}D"
        if f.attr == "astype" and len(n.args) == 1 and isinstance(n.args[0], ast.Name) and n.args[0].id in ("float", "int", "str"):
            return f"cast({self.visit(f.value)} as {({'float': 'double', 'int': 'bigint', 'str': 'string'})[n.args[0].id]})"
        if f.attr in METHOD:
            return self.fill(METHOD[f.attr], [self.visit(f.value), *map(self.visit, n.args)])
        raise CompileError(f"method {f.attr} is not allowed")

    @staticmethod
    def fill(form: str, args: list[str]) -> str:
        try:
            return form.format(*args)
        except IndexError as e:
            raise CompileError("too few arguments") from e


def compile_code(code: str, df: DataFrame) -> tuple[str, list[str]]:
    """(SQL text, source columns) of ``result = ...`` or of a bare expression, fitted on ``df``."""
    try:
        tree = ast.parse(code.strip())
    except SyntaxError as e:
        raise CompileError(f"syntax error: {e}") from e
    if len(tree.body) != 1:
        raise CompileError("one statement that binds result is expected")
    s = tree.body[0]
    if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and s.targets[0].id == "result":
        value = s.value
    elif isinstance(s, ast.Expr):
        value = s.value
    else:
        raise CompileError("one statement that binds result is expected")
    c = _Compiler(df)
    sql = c.visit(value)
    kind = df.select(F.expr(sql).alias("r")).schema["r"].dataType.typeName()
    return (finite(sql) if kind in ("double", "float") else sql), c.source


def validate(code: str, df: DataFrame) -> dict:
    """{valid, error, warnings}: whether the code compiles and resolves on ``df``."""
    warnings = [] if "result" in code else ["result is not bound"]
    try:
        compile_code(code, df)
    except Exception as e:  # noqa: BLE001 - reported, not raised
        return {"valid": False, "error": str(e).split("\n")[0], "warnings": warnings}
    return {"valid": True, "error": None, "warnings": warnings}
