"""Signal formulas compiled to columns: comparisons, and/or, arithmetic, .shift(n), .rolling(n).mean(), abs, max, min."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

_OPERATORS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Gt: operator.gt, ast.GtE: operator.ge,
    ast.Lt: operator.lt, ast.LtE: operator.le, ast.Eq: operator.eq, ast.NotEq: operator.ne,
}


class FormulaError(ValueError):
    """A formula uses what the language does not have."""


def compile_formula(text: str, known: dict[str, Column] | None = None, by: str = "asset", time: str = "h") -> Column:
    """Column of a formula; names are columns, or entries of `known` (signals that others depend on)."""
    window = Window.partitionBy(by).orderBy(time)

    def build(n: ast.AST) -> Column:
        match n:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=bool() | int() | float() as v):
                return F.lit(v)
            case ast.Name(id=name):
                return known[name] if known and name in known else F.col(name)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~build(x)
            case ast.BoolOp(op=op, values=values):
                out = build(values[0])
                for v in values[1:]:
                    out = out & build(v) if isinstance(op, ast.And) else out | build(v)
                return out
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATORS:
                return _OPERATORS[type(op)](build(a), build(b))
            case ast.Compare(left=a, ops=ops, comparators=rest):
                out, left = None, build(a)
                for op, b in zip(ops, rest, strict=True):
                    right = build(b)
                    part = _OPERATORS[type(op)](left, right)
                    out, left = part if out is None else out & part, right
                return out
            case ast.Call(func=ast.Attribute(value=x, attr="shift"), args=[ast.Constant(value=int() as k)]):
                return F.lag(build(x), k).over(window)
            case ast.Call(func=ast.Attribute(value=ast.Call(func=ast.Attribute(value=x, attr="rolling"), args=[ast.Constant(value=int() as k)]), attr="mean"), args=[]):
                frame = window.rowsBetween(1 - k, 0)
                return F.when(F.count("*").over(frame) == k, F.avg(build(x)).over(frame))
            case ast.Call(func=ast.Name(id="abs"), args=[x]):
                return F.abs(build(x))
            case ast.Call(func=ast.Name(id="max" | "min" as name), args=[*xs]) if len(xs) > 1:
                return (F.greatest if name == "max" else F.least)(*map(build, xs))
        raise FormulaError(f"not in the formula language: {ast.dump(n)[:80]}")

    return build(ast.parse(text.replace(" AND ", " and ").replace(" OR ", " or "), mode="eval"))
