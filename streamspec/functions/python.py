"""Typed expressions as Python source, for streams that depend on their own past.

Only the general recursive streams run in Python; the arithmetic follows ``functions.columns``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from fractions import Fraction

from streamspec.analysis.checker import Spec
from streamspec.analysis.types import Type
from streamspec.lang import tree as t

_HIGH, _LOW = 2**63 - 1, -(2**63)


def whole(v: int, least: int = _LOW) -> int:
    """v, if it fits."""
    if not least <= v <= _HIGH:
        raise OverflowError(f"{v} is no number of 64 bits of its type")
    return v


def real(v: float) -> float:
    if v != v:
        raise ArithmeticError("not a number")
    return v


def int_div(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def int_rem(a: int, b: int) -> int:
    return a - b * int_div(a, b)


def real_div(a: float, b: float) -> float:
    if b == 0:
        if a == 0:
            raise ArithmeticError("0 divided by 0")
        return math.copysign(math.inf, a)
    return a / b


def shifted(op: str, a: int, b: int) -> int:
    if not 0 <= b < 64:
        raise OverflowError("shift by 64 or more")
    v = a << b if op == "<<" else a >> b
    return (v + 2**63) % 2**64 - 2**63


def convert(v, source: str, target: str):
    if target == "Float":
        return float(v)
    if source == "Float":
        return int(max(float(_LOW if target == "Int" else 0), min(v, 2.0**63))) if v < 2.0**63 else _HIGH
    return whole(v, 0 if target == "UInt" else _LOW)


def byte_at(b: bytes, i: int):
    return b[i] if 0 <= i < len(b) else None


#: What the generated source can call.
NAMES = {f.__name__: f for f in (whole, real, int_div, int_rem, real_div, shifted, convert, byte_at)} | {"math": math, "re": re}


class Source:
    """Writes expressions as Python. access writes stream accesses."""

    def __init__(self, spec: Spec, access: Callable[[t.Expr], str]):
        self.spec, self.access = spec, access

    def literal(self, e: t.Lit, kind: Type) -> str:
        if isinstance(e.value, Fraction):
            return repr(float(e.value)) if kind.kind == "Float" else repr(int(e.value))
        return repr(e.value)

    def __call__(self, e: t.Expr) -> str:
        kind = self.spec.types.get(e)
        match e:
            case t.Lit():
                return self.literal(e, kind)
            case t.Ident() if e.name in self.spec.constants:
                return self.literal(*self.spec.constants[e.name])
            case t.Ident() | t.Hold() | t.Get() | t.Offset() | t.Aggregate():
                return self.access(e)
            case t.Paren():
                return self(e.value)
            case t.Default():
                return f"(_v if (_v := {self(e.value)}) is not None else {self(e.other)})"
            case t.Ite():
                return f"({self(e.then)} if {self(e.cond)} else {self(e.other)})"
            case t.Tuple():
                return "{" + ", ".join(f"'_{i}': {self(x)}" for i, x in enumerate(e.values)) + "}"
            case t.Field():
                return f"{self(e.value)}['_{e.name}']"
            case t.Unary():
                v = self(e.value)
                return f"(not {v})" if e.op == "!" else f"(~{v})" if e.op == "~" else self.bounded(f"-({v})", kind)
            case t.Binary():
                return self.binary(e, kind)
            case t.Call():
                return self.call(e, kind)
        raise AssertionError(e)

    def bounded(self, source: str, kind: Type) -> str:
        if kind.kind == "Float":
            return f"real({source})"
        return f"whole({source}, 0)" if kind.kind == "UInt" else f"whole({source})"

    def binary(self, e: t.Binary, kind: Type) -> str:
        a, b = self(e.left), self(e.right)
        match e.op:
            case "&&" | "||":
                return f"({a} {'and' if e.op == '&&' else 'or'} {b})"
            case "==" | "!=" | "<" | "<=" | ">" | ">=" | "&" | "|" | "^":
                return f"({a} {e.op} {b})"
            case "<<" | ">>":
                return f"shifted('{e.op}', {a}, {b})"
            case "+" | "-" | "*" | "**":
                return self.bounded(f"({a}) {e.op} ({b})", kind)
            case "/":
                return f"real_div({a}, {b})" if kind.kind == "Float" else f"int_div({a}, {b})"
            case "%":
                return f"math.fmod({a}, {b})" if kind.kind == "Float" else f"int_rem({a}, {b})"
        raise AssertionError(e.op)

    def call(self, e: t.Call, kind: Type) -> str:
        args = ([e.self_] if e.self_ is not None else []) + [v for _, v in e.args]
        own = [self(a) for a in args]
        match e.name:
            case "sqrt" | "sin" | "cos":
                return f"math.{e.name}({own[0]})"
            case "arctan":
                return f"math.atan({own[0]})"
            case "abs" | "min" | "max":
                return f"{e.name}({', '.join(own)})"
            case "cast":
                return f"convert({own[0]}, '{self.spec.types[args[0]].kind}', '{kind.kind}')"
            case "matches":
                text = f"({own[0]}).decode('latin-1')" if self.spec.types[args[0]].kind == "Bytes" else own[0]
                return f"(re.search({args[1].value!r}, {text}) is not None)"
            case "at":
                return f"byte_at({own[0]}, {own[1]})"
        raise AssertionError(e.name)
