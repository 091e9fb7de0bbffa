"""Typed expressions as Spark columns.

Integers are LONG and floats DOUBLE at run time, whatever their declared width. A value that may be
missing is a null; a stream's column is a struct around the value, null where the stream has none,
so that a missing value that was stored is told from no value at all.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from streamspec.analysis.checker import Spec
from streamspec.analysis.types import Type
from streamspec.lang import tree as t

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def sql_type(kind: Type) -> str:
    """The Spark type of values."""
    match kind.kind:
        case "Tuple":
            return "struct<" + ",".join(f"_{i}:{sql_type(x)}" for i, x in enumerate(kind.items)) + ">"
        case "Option":
            return sql_type(kind.items[0])
    return {"Bool": "boolean", "String": "string", "Bytes": "binary", "Int": "bigint", "UInt": "bigint", "Float": "double"}[kind.kind]


def literal(e: t.Lit, kind: Type) -> Column:
    if isinstance(e.value, Fraction):
        return F.lit(float(e.value)).cast("double") if kind.kind == "Float" else F.lit(int(e.value)).cast("bigint")
    return F.lit(e.value)


def fail(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def not_nan(c: Column) -> Column:
    return F.when(F.isnan(c), fail("not a number", "double")).otherwise(c)


def divide(a: Column, b: Column) -> Column:
    """Floats: a number over 0 is infinite, 0 over 0 an error."""
    zero = F.when(a == 0.0, fail("0 divided by 0", "double")).when(a > 0.0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0.0, zero).otherwise(a / F.when(b == 0.0, F.lit(1.0)).otherwise(b))


def power(a: Column, b: Column, kind: Type, exponent: int | None) -> Column:
    if kind.kind == "Float":
        return not_nan(F.pow(a, b))
    if exponent is not None and 0 <= exponent <= 64:
        out, square, n = F.lit(1).cast("bigint"), a, exponent
        while n:
            if n & 1:
                out = out * square
            n >>= 1
            if n:
                square = square * square
        return out
    # Beyond 64 either every number overflows or only whether the exponent is odd matters.
    times = F.sequence(F.lit(1).cast("bigint"), F.when(b > 0, F.least(b, b % 2 + 64)).otherwise(F.lit(1).cast("bigint")))
    product = F.aggregate(times, F.lit(1).cast("bigint"), lambda acc, _: acc * a)
    return F.when(b < 0, fail("negative exponent", "bigint")).when(b == 0, F.lit(1).cast("bigint")).otherwise(product)


def unsigned(c: Column, what: str) -> Column:
    return F.when(c < 0, fail(f"{what} of unsigned numbers is negative", "bigint")).otherwise(c)


def shift(op: str, a: Column, b: Column) -> Column:
    moved = F.call_function("shiftleft" if op == "<<" else "shiftright", a, b.cast("int"))
    return F.when((b < 0) | (b >= 64), fail("shift by 64 or more", "bigint")).otherwise(moved)


def convert(c: Column, source: Type, target: Type) -> Column:
    """A cast between families: floats to the nearest integer that fits, towards 0."""
    if target.kind == "Float":
        return c.cast("double")
    if source.kind == "Float":
        low = LONG_MIN if target.kind == "Int" else 0
        return F.when(c >= float(2**63), F.lit(LONG_MAX)).when(c <= float(low), F.lit(low).cast("bigint")).otherwise(F.when((c < float(2**63)) & (c > float(low)), c).cast("bigint"))
    if source.kind == "Int" and target.kind == "UInt":
        return unsigned(c, "a cast")
    return c


def byte_at(c: Column, i: Column) -> Column:
    n = F.octet_length(c)
    inside = (i >= 0) & (i < n)
    one = F.hex(c.substr(F.when(inside, i.cast("int")).otherwise(F.lit(0)) + 1, F.lit(1)))
    return F.when(inside, F.conv(one, 16, 10).cast("bigint"))


class Columns:
    """Compiles expressions. access gives the column of a stream access: the value for sync, which is
    there, and the value or null for hold, get, offset and windows."""

    def __init__(self, spec: Spec, access: Callable[[t.Expr], Column]):
        self.spec, self.access = spec, access

    def __call__(self, e: t.Expr) -> Column:
        kind = self.spec.types.get(e)
        match e:
            case t.Lit():
                return literal(e, kind)
            case t.Ident() if e.name in self.spec.constants:
                return literal(*self.spec.constants[e.name])
            case t.Ident() | t.Hold() | t.Get() | t.Offset() | t.Aggregate():
                return self.access(e)
            case t.Paren():
                return self(e.value)
            case t.Default():
                return F.coalesce(self(e.value), self(e.other))
            case t.Ite():
                return F.when(self(e.cond), self(e.then)).otherwise(self(e.other))
            case t.Tuple():
                return F.struct(*[self(x).alias(f"_{i}") for i, x in enumerate(e.values)]) if e.values else F.struct(F.lit(None).alias("_"))
            case t.Field():
                return self(e.value)[f"_{e.name}"]
            case t.Unary():
                return self.unary(e)
            case t.Binary():
                return self.binary(e)
            case t.Call():
                return self.call(e)
        raise AssertionError(e)

    def unary(self, e: t.Unary) -> Column:
        v = self(e.value)
        return ~v if e.op == "!" else -v if e.op == "-" else F.bitwise_not(v)

    def binary(self, e: t.Binary) -> Column:
        a, b, wide = self(e.left), self(e.right), self.spec.types[e]
        match e.op:
            case "&&":
                return F.when(a, b).otherwise(F.lit(False))
            case "||":
                return F.when(a, F.lit(True)).otherwise(b)
            case "==":
                return a == b
            case "!=":
                return a != b
            case "<":
                return a < b
            case "<=":
                return a <= b
            case ">":
                return a > b
            case ">=":
                return a >= b
            case "&":
                return a.bitwiseAND(b)
            case "|":
                return a.bitwiseOR(b)
            case "^":
                return a.bitwiseXOR(b)
            case "<<" | ">>":
                return shift(e.op, a, b)
            case "+":
                return a + b
            case "-":
                return unsigned(a - b, "a difference") if wide.kind == "UInt" else a - b
            case "*":
                return a * b
            case "/":
                return divide(a, b) if wide.kind == "Float" else F.call_function("div", a, b)
            case "%":
                if wide.kind != "Float":
                    return a % b
                return F.when(b == 0.0, fail("remainder of a division by 0", "double")).otherwise(a % F.when(b == 0.0, F.lit(1.0)).otherwise(b))
            case "**":
                n = e.right.value if isinstance(e.right, t.Lit) else None
                return power(a, b, wide, int(n) if n is not None and n.denominator == 1 else None)
        raise AssertionError(e.op)

    def call(self, e: t.Call) -> Column:
        args = ([e.self_] if e.self_ is not None else []) + [v for _, v in e.args]
        cols = [self(a) for a in args]
        match e.name:
            case "sqrt":
                return not_nan(F.sqrt(cols[0]))
            case "sin":
                return not_nan(F.sin(cols[0]))
            case "cos":
                return not_nan(F.cos(cols[0]))
            case "arctan":
                return F.atan(cols[0])
            case "abs":
                return F.abs(cols[0])
            case "min":
                return F.least(*cols)
            case "max":
                return F.greatest(*cols)
            case "cast":
                return convert(cols[0], self.spec.types[args[0]], self.spec.types[e])
            case "matches":
                text = F.decode(cols[0], "ISO-8859-1") if self.spec.types[args[0]].kind == "Bytes" else cols[0]
                return text.rlike(args[1].value)
            case "at":
                return byte_at(cols[0], cols[1])
        raise AssertionError(e.name)

