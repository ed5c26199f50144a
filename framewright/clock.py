"""Exact rational time: every comparison within a clock is one of whole ticks."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction


@dataclass(frozen=True)
class Clock:
    """A time base in seconds per tick."""

    base: Fraction

    def more_than(self, seconds: Fraction) -> int:
        """dt * base > seconds exactly if dt > this."""
        return (seconds / self.base).__floor__()

    def at_least(self, seconds: Fraction) -> int:
        """dt * base >= seconds exactly if dt >= this."""
        return (seconds / self.base).__ceil__()


MICROSECONDS = Clock(Fraction(1, 1_000_000))


def exact(text: str) -> Fraction:
    """A canonical rational string, or an error."""
    value = Fraction(text)
    if len(text) > 64 or str(value) != text:
        raise ValueError("not a canonical rational")
    return value
