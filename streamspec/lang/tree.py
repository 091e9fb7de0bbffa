"""Syntax tree of a specification, and how its nodes are written.

Every node has ``at``, its place in the source, and prints in the normalised form that the default
messages of triggers use.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

#: How operators print, by the spelling that the tree keeps.
PRINTED = {"&&": "∧", "||": "∨", "==": "=", "!=": "≠", "<=": "≤", ">=": "≥"}
WINDOW_PRINTED = {"sum": "Σ", "avg": "avg", "count": "#", "integral": "∫", "min": "min", "max": "max", "exists": "∃", "forall": "∀"}


@dataclass(eq=False)
class Expr:
    at: int = field(default=0, kw_only=True)


@dataclass(eq=False)
class Lit(Expr):
    """value: bool, str, or Fraction for numbers; text is the number as written."""

    value: bool | str | Fraction
    text: str = ""
    unit: str | None = None
    raw: bool = False

    def __str__(self) -> str:
        if isinstance(self.value, bool):
            return "true" if self.value else "false"
        if isinstance(self.value, str):
            if not self.raw:
                return f'"{self.value}"'
            pad = ""
            while f'{pad}"' in self.value:
                pad += "#"
            return f'r{pad}"{self.value}"{pad}'
        return self.text + (self.unit or "")


@dataclass(eq=False)
class Ident(Expr):
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(eq=False)
class Hold(Expr):
    """The latest value of a stream."""

    target: Expr

    def __str__(self) -> str:
        return f"{self.target}.hold()"


@dataclass(eq=False)
class Get(Expr):
    """The value of a stream if it has one at this instant."""

    target: Expr

    def __str__(self) -> str:
        return f"{self.target}.get()"


@dataclass(eq=False)
class Offset(Expr):
    """by: a number literal, with a unit for real-time offsets. steps is set by the analysis."""

    target: Expr
    by: Lit
    steps: int = 0

    def __str__(self) -> str:
        return f"{self.target}.offset(by: {self.by})"


@dataclass(eq=False)
class Aggregate(Expr):
    """A sliding window over a stream. number is set by the analysis."""

    target: Expr
    duration: Expr
    exactly: bool
    function: str
    number: int = -1

    def __str__(self) -> str:
        return f"{self.target}.aggregate({'over_exactly' if self.exactly else 'over'}: {self.duration}, using: {WINDOW_PRINTED[self.function]})"


@dataclass(eq=False)
class Default(Expr):
    value: Expr
    other: Expr

    def __str__(self) -> str:
        return f"{self.value}.defaults(to: {self.other})"


@dataclass(eq=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left} {PRINTED.get(self.op, self.op)} {self.right}"


@dataclass(eq=False)
class Unary(Expr):
    op: str
    value: Expr

    def __str__(self) -> str:
        return f"{self.op}{self.value}"


@dataclass(eq=False)
class Ite(Expr):
    cond: Expr
    then: Expr
    other: Expr

    def __str__(self) -> str:
        return f"if {self.cond} then {self.then} else {self.other}"


@dataclass(eq=False)
class Paren(Expr):
    """closed is false where the closing parenthesis is missing."""

    value: Expr
    closed: bool = True

    def __str__(self) -> str:
        return f"({self.value}" + ")" * self.closed


@dataclass(eq=False)
class Tuple(Expr):
    values: list[Expr]

    def __str__(self) -> str:
        return "(" + ", ".join(map(str, self.values)) + ")"


@dataclass(eq=False)
class Field(Expr):
    value: Expr
    name: str

    def __str__(self) -> str:
        return f"{self.value}.{self.name}"


@dataclass(eq=False)
class Call(Expr):
    """A function call or, with self, a method call. args: name or None, and value."""

    name: str
    args: list[tuple[str | None, Expr]]
    generics: list[TypeRef] = field(default_factory=list)
    self_: Expr | None = None

    @property
    def key(self) -> str:
        return f"{self.name}({''.join(f'{n or '_'}:' for n, _ in self.args)})"

    def __str__(self) -> str:
        generic = f"<{', '.join(map(str, self.generics))}>" if self.generics else ""
        args = ", ".join(f"{n}: {v}" if n else str(v) for n, v in self.args)
        return (f"{self.self_}." if self.self_ is not None else "") + f"{self.name}{generic}({args})"


@dataclass
class TypeRef:
    """A type as written: a name, a tuple of types, or _."""

    name: str = ""
    items: list[TypeRef] | None = None
    optional: bool = False
    at: int = 0

    def __str__(self) -> str:
        if self.items is not None:
            return "(" + ", ".join(map(str, self.items)) + ")"
        return self.name + "?" * self.optional


@dataclass
class Parameter:
    name: str
    type: TypeRef | None
    at: int = 0

    def __str__(self) -> str:
        return self.name + (f": {self.type}" if self.type else "")


@dataclass
class Constant:
    name: str
    type: TypeRef
    value: Lit
    at: int = 0

    def __str__(self) -> str:
        return f"constant {self.name}: {self.type} := {self.value}"


@dataclass
class Input:
    name: str
    type: TypeRef
    params: list[Parameter] = field(default_factory=list)
    at: int = 0

    def __str__(self) -> str:
        params = f" ({', '.join(map(str, self.params))})" if self.params else ""
        return f"input {self.name}{params}: {self.type}"


@dataclass
class Output:
    name: str
    type: TypeRef | None
    expr: Expr
    activation: Expr | None = None
    params: list[Parameter] = field(default_factory=list)
    template: dict[str, Expr] = field(default_factory=dict)
    close: Expr | None = None
    at: int = 0

    def __str__(self) -> str:
        params = f" ({', '.join(map(str, self.params))})" if self.params else ""
        parts = [f"output {self.name}{params}"]
        parts[0] += f": {self.type}" if self.type else ""
        if self.activation is not None:
            parts.append(f"@{self.activation}")
        if self.template:
            parts.append("{ " + " ".join(f"{k} {v}" for k, v in self.template.items()) + " }")
        if self.close is not None:
            parts.append(f"close {self.close}")
        return " ".join(parts) + f" := {self.expr}"


@dataclass
class Trigger:
    expr: Expr
    message: str | None = None
    at: int = 0

    def __str__(self) -> str:
        return f"trigger {self.expr}" + (f' "{self.message}"' if self.message is not None else "")


@dataclass
class TypeDecl:
    name: str
    fields: list[tuple[str, TypeRef]]
    at: int = 0

    def __str__(self) -> str:
        return f"type {self.name} {{ {', '.join(f'{n}: {t}' for n, t in self.fields)} }}"


@dataclass
class Tree:
    """A whole specification."""

    source: str
    imports: list[tuple[str, int]] = field(default_factory=list)
    types: list[TypeDecl] = field(default_factory=list)
    constants: list[Constant] = field(default_factory=list)
    inputs: list[Input] = field(default_factory=list)
    outputs: list[Output] = field(default_factory=list)
    triggers: list[Trigger] = field(default_factory=list)
    warnings: list = field(default_factory=list)

    def __str__(self) -> str:
        lines = [f"import {name}" for name, _ in self.imports]
        lines += map(str, [*self.types, *self.constants, *self.inputs, *self.outputs, *self.triggers])
        return "".join(f"{x}\n" for x in lines)


def children(e: Expr) -> list[Expr]:
    """The direct parts of an expression."""
    match e:
        case Hold() | Get() | Offset() | Aggregate():
            return [e.target]
        case Default():
            return [e.value, e.other]
        case Binary():
            return [e.left, e.right]
        case Unary() | Paren() | Field():
            return [e.value]
        case Ite():
            return [e.cond, e.then, e.other]
        case Tuple():
            return list(e.values)
        case Call():
            return ([e.self_] if e.self_ is not None else []) + [v for _, v in e.args]
    return []


def walk(e: Expr):
    """The expression and all its parts."""
    yield e
    for c in children(e):
        yield from walk(c)
