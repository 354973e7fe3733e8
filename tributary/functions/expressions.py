"""Derived-column expressions.

Expression text is Python arithmetic over column names (``amount * 2``, ``a // b``,
``'hi' if x > 3 else 'lo'``) with Python's rules for floor division, modulo and power, or, when it
is not that, Spark SQL text. Python text is read by Python's own parser and becomes a Spark
column, so no row ever reaches Python. An operation that Python would refuse for a row (division
by zero, overflow, a text times a text) gives null for that row and the job goes on.
``{name}`` stands for a variable in both forms.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import values as V
from tributary.functions.names import col, quote

INT, FLOAT, TEXT, BOOL, OTHER = "int", "float", "text", "bool", "other"


class NotPython(Exception):
    """The text is not a Python expression this module knows; it is left to Spark SQL."""


class UnknownName(ValueError):
    pass


def python_expression(text: str, schema: T.StructType, variables: Mapping[str, Any] | None = None) -> Column:
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise NotPython(str(e)) from None
    return _Reader(schema, variables or {}).read(tree.body)[0]


class _Reader:
    def __init__(self, schema: T.StructType, variables: Mapping[str, Any]):
        self.schema, self.variables = schema, variables

    def read(self, node: ast.AST) -> tuple[Column, str]:
        reader = getattr(self, "_" + type(node).__name__, None)
        if reader is None:
            raise NotPython(type(node).__name__)
        return reader(node)

    def literal(self, value: Any) -> tuple[Column, str]:
        if isinstance(value, bool):
            return F.lit(value), BOOL
        if isinstance(value, int):
            return (F.lit(value).cast("long"), INT) if V.INT64[0] <= value <= V.INT64[1] else (F.lit(float(value)), FLOAT)
        if isinstance(value, float):
            return F.lit(value), FLOAT
        if isinstance(value, str):
            return F.lit(value), TEXT
        if value is None:
            return F.lit(None), OTHER
        raise NotPython(repr(value))

    def _Constant(self, node: ast.Constant):
        return self.literal(node.value)

    def _Name(self, node: ast.Name):
        if node.id not in self.schema.fieldNames():
            raise UnknownName(f"unknown name '{node.id}' in expression; columns are {self.schema.fieldNames()}")
        dtype, c = V.field_type(self.schema, node.id), col(node.id)
        if isinstance(dtype, T.IntegralType):
            return c.cast("long"), INT
        if isinstance(dtype, T.NumericType):
            return c.cast("double"), FLOAT
        return c, {"text": TEXT, "boolean": BOOL}.get(V.kind(dtype), OTHER)

    def _Set(self, node: ast.Set):
        return self.literal(self._variable(node))

    def _variable(self, node: ast.AST) -> Any:
        if isinstance(node, ast.Set) and len(node.elts) == 1 and isinstance(node.elts[0], ast.Name):
            name = node.elts[0].id
            if name in self.variables:
                return self.variables[name]
            raise UnknownName(f"unknown variable '{name}' in expression")
        raise NotPython("set")

    def _BinOp(self, node: ast.BinOp):
        (a, ak), (b, bk) = self.read(node.left), self.read(node.right)
        op = type(node.op)
        if op is ast.Add and ak == bk == TEXT:
            return F.concat(a, b), TEXT
        if op is ast.Mult and {ak, bk} == {TEXT, INT}:
            text, times = (a, b) if ak == TEXT else (b, a)
            return F.repeat(text, F.greatest(times, F.lit(0)).try_cast("int")), TEXT
        if OTHER in (ak, bk):
            raise NotPython("arithmetic on dates or nested values")
        if TEXT in (ak, bk):
            if op is ast.Mod and ak == TEXT:
                raise NotPython("text formatting")
            return F.lit(None).cast("double"), FLOAT
        a, b = (x.cast("long") if k == BOOL else x for x, k in ((a, ak), (b, bk)))
        out = FLOAT if FLOAT in (ak, bk) else INT
        if out == FLOAT:
            a, b = a.cast("double"), b.cast("double")
        if op is ast.Add:
            return F.try_add(a, b), out
        if op is ast.Sub:
            return F.try_subtract(a, b), out
        if op is ast.Mult:
            return F.try_multiply(a, b), out
        if op is ast.Div:
            return F.try_divide(a.cast("double"), b.cast("double")), FLOAT
        if op is ast.Mod:
            return _modulo(a, b), out
        if op is ast.FloorDiv:
            if out == INT:
                whole = F.try_subtract(a, _modulo(a, b))
                return F.call_function("div", whole, F.nullif(b, F.lit(0).cast("long"))), INT
            return F.try_divide(F.try_subtract(a, _modulo(a, b)), b), FLOAT
        if op is ast.Pow and out == INT and isinstance(node.right, ast.Constant) and 0 <= int(node.right.value) <= 64:
            return _whole_power(a, int(node.right.value)), INT
        if op is ast.Pow:
            power = F.pow(a.cast("double"), b.cast("double"))
            finite = F.when(~F.isnan(power) & (F.abs(power) < F.lit(float("inf"))), power)
            whole = out == INT and isinstance(node.right, ast.Constant)
            return (finite.try_cast("long"), INT) if whole else (finite, FLOAT)
        if out == INT and op in (ast.BitAnd, ast.BitOr, ast.BitXor):
            return {ast.BitAnd: a.bitwiseAND, ast.BitOr: a.bitwiseOR, ast.BitXor: a.bitwiseXOR}[op](b), INT
        raise NotPython(op.__name__)

    def _UnaryOp(self, node: ast.UnaryOp):
        c, k = self.read(node.operand)
        if isinstance(node.op, ast.Not):
            return ~self._truth(c, k), BOOL
        if k in (TEXT, OTHER):
            raise NotPython("sign of a text")
        number, k = (c.cast("long"), INT) if k == BOOL else (c, k)
        if isinstance(node.op, ast.USub):
            return F.try_subtract(F.lit(0).cast("long" if k == INT else "double"), number), k
        if isinstance(node.op, ast.UAdd):
            return number, k
        raise NotPython(type(node.op).__name__)

    def _Compare(self, node: ast.Compare):
        tests, left = [], node.left
        for op, right in zip(node.ops, node.comparators):
            tests.append(self._compare(left, op, right))
            left = right
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out, BOOL

    def _compare(self, left: ast.AST, op: ast.cmpop, right: ast.AST) -> Column:
        a, ak = self.read(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            test = self._inside(a, ak, right)
            return ~test if isinstance(op, ast.NotIn) else test
        if isinstance(op, (ast.Is, ast.IsNot)) or (isinstance(right, ast.Constant) and right.value is None):
            if not (isinstance(right, ast.Constant) and right.value is None):
                raise NotPython("is")
            return a.isNotNull() if isinstance(op, (ast.IsNot, ast.NotEq)) else a.isNull()
        b, bk = self.read(right)
        numeric = {INT, FLOAT, BOOL}
        if ak != bk and not {ak, bk} <= numeric and OTHER not in (ak, bk):
            if isinstance(op, (ast.Eq, ast.NotEq)):
                return F.lit(isinstance(op, ast.NotEq))
            return F.lit(None).cast("boolean")
        if ak != bk and {ak, bk} <= numeric:
            a, b = a.cast("double"), b.cast("double")
        match op:
            case ast.Eq():
                return a == b
            case ast.NotEq():
                return a != b
            case ast.Lt():
                return a < b
            case ast.LtE():
                return a <= b
            case ast.Gt():
                return a > b
            case ast.GtE():
                return a >= b
        raise NotPython(type(op).__name__)

    def _inside(self, a: Column, ak: str, right: ast.AST) -> Column:
        if isinstance(right, (ast.Tuple, ast.List)):
            return a.isin([self.read(e)[0] for e in right.elts])
        if isinstance(right, ast.Set):
            items = self._variable(right)
            if isinstance(items, (list, tuple)):
                return a.isin([F.lit(i) for i in items]) if items else F.lit(False)
        b, bk = self.read(right)
        if ak == bk == TEXT:
            return F.contains(b, a)
        raise NotPython("in")

    def _BoolOp(self, node: ast.BoolOp):
        conj = isinstance(node.op, ast.And)
        out, k = self.read(node.values[0])
        for v in node.values[1:]:
            c, ck = self.read(v)
            if k == ck == BOOL:
                out = (out & c) if conj else (out | c)
            elif k == ck:
                truth = self._truth(out, k)
                out = F.when(truth, c).otherwise(out) if conj else F.when(truth, out).otherwise(c)
            else:
                raise NotPython("and/or over different kinds")
        return out, k

    def _IfExp(self, node: ast.IfExp):
        test = self._truth(*self.read(node.test))
        (a, ak), (b, bk) = self.read(node.body), self.read(node.orelse)
        if ak == bk or OTHER in (ak, bk):
            return F.when(test, a).otherwise(b), ak if ak != OTHER else bk
        if {ak, bk} <= {INT, FLOAT, BOOL}:
            return F.when(test, a.cast("double")).otherwise(b.cast("double")), FLOAT
        return F.when(test, a.cast("string")).otherwise(b.cast("string")), TEXT

    def _Call(self, node: ast.Call):
        if not isinstance(node.func, ast.Name) or node.keywords or len(node.args) != 1:
            raise NotPython("call")
        if node.func.id not in ("int", "float", "str"):
            raise NotPython(node.func.id)
        c, k = self.read(node.args[0])
        if node.func.id == "str":
            return c.cast("string"), TEXT
        if node.func.id == "float":
            return c.try_cast("double") if k == TEXT else c.cast("double"), FLOAT
        return c.try_cast("long"), INT

    def _truth(self, c: Column, k: str) -> Column:
        if k == OTHER:
            return c.isNotNull()
        test = c if k == BOOL else (c != "" if k == TEXT else c != 0)
        return F.coalesce(test, F.lit(False))


def _whole_power(a: Column, exponent: int) -> Column:
    """Exact, null beyond a long. Numbers whose power is beyond are told by their size: an overflow in each row would cost an exception in each."""
    base = a.cast("long")
    out, factor, left = F.lit(1).cast("long"), base, exponent
    while left:
        if left % 2:
            out = F.try_multiply(out, factor)
        left //= 2
        if left:
            factor = F.try_multiply(factor, factor)
    if exponent < 2:
        return F.when(a.isNotNull(), out)
    least, most = _roots(exponent)
    return F.when(base.between(F.lit(least).cast("long"), F.lit(most).cast("long")), out)


def _roots(exponent: int) -> tuple[int, int]:
    """The least and the largest whole number whose power is a long."""
    lowest, highest = V.INT64

    def largest(limit: int) -> int:
        low, high = 1, 1 << 32
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if middle**exponent <= limit else (low, middle)
        return low

    return -largest(highest if exponent % 2 == 0 else -lowest), largest(highest)


def _modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; null for a zero divisor."""
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


VARIABLE = re.compile(r"\{([A-Za-z_]\w*)\}")


class Bindings:
    """Variables used inside SQL text. ``{name}`` becomes a helper column holding a literal, a
    list becomes ``(h0, h1, ...)``; values are never pasted into the text, and Catalyst folds the
    helpers away."""

    def __init__(self, variables: Mapping[str, Any] | None, prefix: str = "__var"):
        self.variables, self.prefix = variables or {}, prefix
        self.literals: dict[str, Column] = {}

    def bind(self, text: str) -> str:
        return VARIABLE.sub(self._helper, text)

    def _helper(self, found: re.Match) -> str:
        name = found[1]
        if name not in self.variables:
            return found[0]
        value = self.variables[name]
        if isinstance(value, DataFrame):
            raise ValueError(f"variable '{name}' is a captured column and cannot stand inside an expression")
        if isinstance(value, (list, tuple)):
            if not value:
                return "(NULL)"
            return "(" + ", ".join(self._one(f"{name}_{i}", v) for i, v in enumerate(value)) + ")"
        return self._one(name, value)

    def _one(self, name: str, value: Any) -> str:
        helper = f"{self.prefix}_{name}"
        self.literals[helper] = F.lit(value)
        return quote(helper)

    def attach(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[c.alias(n) for n, c in self.literals.items()]) if self.literals else df
