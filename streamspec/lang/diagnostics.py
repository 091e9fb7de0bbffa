"""Errors and warnings with their places."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Diagnostic:
    """kind: syntax, verify, name, type, clock or graph."""

    kind: str
    message: str
    line: int
    column: int

    def __str__(self) -> str:
        return f"{self.line}:{self.column}: {self.kind}: {self.message}"


class SpecError(ValueError):
    """A specification that cannot be run, with all that is wrong with it."""

    def __init__(self, errors: list[Diagnostic]):
        self.errors = errors
        super().__init__("\n".join(map(str, errors)))


class Report:
    """Collects what the analyses find in one source."""

    def __init__(self, source: str):
        self.source = source
        self.errors: list[Diagnostic] = []
        self.warnings: list[Diagnostic] = []

    def place(self, at: int) -> tuple[int, int]:
        before = self.source[:at]
        return before.count("\n") + 1, at - (before.rfind("\n") + 1) + 1

    def error(self, kind: str, message: str, at: int) -> None:
        self.errors.append(Diagnostic(kind, message, *self.place(at)))

    def warn(self, kind: str, message: str, at: int) -> None:
        self.warnings.append(Diagnostic(kind, message, *self.place(at)))

    def check(self) -> None:
        if self.errors:
            raise SpecError(self.errors)
