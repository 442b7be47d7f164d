"""Safe expressions over named traces, compiled to columns; and one-line chains of operators."""

from __future__ import annotations

import ast
import operator
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Mod: lambda a, b: F.pmod(a, b), ast.Pow: lambda a, b: F.pow(a, b),
    ast.Div: lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(float("nan"))), ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)),
}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
FUNCTIONS = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "log2": F.log2, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin,
    "arccos": F.acos, "arctan": F.atan, "floor": F.floor, "ceil": F.ceil, "sign": F.signum, "minimum": F.least, "maximum": F.greatest, "where": lambda c, a, b: F.when(c, a).otherwise(b),
}


def compile_expression(text: str, names: Mapping[str, Column]) -> Column:
    """Arithmetic, comparisons, and/or/not, ``a if c else b`` and the functions above; all else is refused.
    Division by zero gives NaN."""

    def go(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, bool)):
            return F.lit(n.value)
        if isinstance(n, ast.Name):
            if n.id not in names:
                raise ValueError(f"unknown name {n.id!r}")
            return names[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](go(n.left), go(n.right))
        if isinstance(n, ast.UnaryOp):
            v = go(n.operand)
            if isinstance(n.op, ast.USub):
                return -v
            if isinstance(n.op, ast.Not):
                return ~v
        if isinstance(n, ast.Compare) and all(type(o) in _COMPARE for o in n.ops):
            sides = [go(x) for x in (n.left, *n.comparators)]
            out = None
            for o, a, b in zip(n.ops, sides[:-1], sides[1:], strict=True):
                c = _COMPARE[type(o)](a, b)
                out = c if out is None else out & c
            return out
        if isinstance(n, ast.BoolOp):
            parts = [go(v) for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(n.op, ast.And) else out | p
            return out
        if isinstance(n, ast.IfExp):
            return F.when(go(n.test), go(n.body)).otherwise(go(n.orelse))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and not n.keywords:
            return FUNCTIONS[n.func.id](*[go(a) for a in n.args])
        raise ValueError(f"not allowed: {ast.dump(n)[:80]}")

    return go(ast.parse(text, mode="eval").body)
