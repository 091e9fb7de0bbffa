"""Durations and frequencies as exact numbers."""

from __future__ import annotations

from fractions import Fraction

#: Seconds of a unit, and hertz of a unit.
SECONDS = {
    "ns": Fraction(1, 10**9), "us": Fraction(1, 10**6), "μs": Fraction(1, 10**6), "ms": Fraction(1, 1000), "s": Fraction(1),
    "min": Fraction(60), "h": Fraction(3600), "d": Fraction(86400), "w": Fraction(604800), "a": Fraction(365 * 86400),
}
HERTZ = {
    "μHz": Fraction(1, 10**6), "uHz": Fraction(1, 10**6), "mHz": Fraction(1, 1000), "Hz": Fraction(1),
    "kHz": Fraction(1000), "MHz": Fraction(10**6), "GHz": Fraction(10**9),
}
NANOS = 10**9


def seconds(value: Fraction, unit: str | None) -> Fraction | None:
    """A duration in seconds, None if the unit is no unit of time."""
    return value * SECONDS[unit] if unit in SECONDS else None


def hertz(value: Fraction, unit: str | None) -> Fraction | None:
    """A frequency; a duration is the frequency of its period."""
    if unit in HERTZ:
        return value * HERTZ[unit]
    if unit in SECONDS and value:
        return 1 / (value * SECONDS[unit])
    return None


def nanos(s: Fraction) -> int:
    """Whole nanoseconds."""
    return int(s * NANOS)
