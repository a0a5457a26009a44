"""Validation of a cast value by declared keywords, on exact numbers."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from . import kernel as k
from .codes import INT_RANGES, Door, Rounding
from .declarations import INVARIANT, Constraints, NumFormat, fold


class Violation(Exception):
    """A value of the type that breaks a keyword; it carries the value as cast, a text as trimmed."""

    def __init__(self, keyword: str, value, offset: int, length: int):
        super().__init__(keyword)
        self.keyword, self.value, self.offset, self.length = keyword, value, offset, length

    def map(self, f) -> Violation:
        """The same with f of its value."""
        return Violation(self.keyword, f(self.value), self.offset, self.length)


def _snapped(x: Fraction, step: Fraction, rounding: Rounding) -> Fraction | None:
    q = x / step
    if q.denominator == 1:
        return x
    if rounding == Rounding.STRICT:
        return None
    low = q.numerator // q.denominator
    if rounding == Rounding.MIDPOINT:
        return round(q) * step  # ties to even
    return (low + (rounding == Rounding.CEILING)) * step


def _bound(x: Fraction, c: Constraints) -> str | None:
    for name, limit, broken in (
        ("minimum", c.minimum, lambda m: x < m), ("exclusiveMinimum", c.exclusive_minimum, lambda m: x <= m),
        ("maximum", c.maximum, lambda m: x > m), ("exclusiveMaximum", c.exclusive_maximum, lambda m: x >= m),
    ):
        if limit is not None and broken(Fraction(limit)):
            return name
    return None


def _deliver(x: Fraction, door: Door, span):
    """x as the door's type, or None if it isn't in its range."""
    if door.is_integer:
        low, high, _ = INT_RANGES[door]
        return int(x) if low <= x <= high else None
    if door == Door.DECIMAL:
        scale = 0
        while (x * 10**scale).denominator != 1:
            scale += 1
            if scale > 28:
                return None
        n = abs(int(x * 10**scale))
        return k.canonical(x < 0, n, scale) if n < 1 << 96 else None
    try:
        y = float(x)
        y = k.f32_from_f64(y) if door == Door.F32 else y
    except (k.Fault, OverflowError):
        return None
    return y + 0.0


def _judge(value, exact: Fraction, door: Door, c: Constraints, offset: int, length: int):
    """(delivered, adjusted, no enum index: numbers have none)."""

    def broken(keyword):
        return Violation(keyword, value, offset, length)

    adjusted = False
    if c.multiple_of is not None:
        snapped = _snapped(exact, Fraction(c.multiple_of), c.rounding)
        if snapped is None:
            raise broken("multipleOf")
        adjusted, exact = snapped != exact, snapped
    if name := _bound(exact, c):
        raise broken(name)
    if c.enum is not None and all(Fraction(e) != exact for e in c.enum):
        raise broken("enum")
    out = _deliver(exact, door, None) if adjusted else value
    if out is None:
        raise broken("multipleOf")
    if door in (Door.F32, Door.F64) and (name := _bound(Fraction(out), c)):
        raise broken(name)
    return out, adjusted, None


def cast_checked(s: str, door: Door, c: Constraints, fmt: NumFormat = INVARIANT):
    """At the numeric doors and the text door; the other doors take no keywords."""
    if door == Door.TEXT:
        return _text(s, c)
    if door.is_integer:
        value = k.cast_int(s, door, fmt)
        exact = Fraction(value)
    elif door == Door.DECIMAL:
        value = k.cast_decimal(s, fmt)
        exact = Fraction(value[0], 10 ** value[1]) * (-1 if value[2] else 1)
    else:
        value = k.cast_float(s, door, fmt)
        a, b = k.edges(s)
        negative, whole, fraction, exponent = k.read_real(s[a:b], fmt)
        # the text's own value, unless it is so long or small that the float is as near as a bound can tell
        exact = Fraction(value) if abs(exponent) > 2000 else Fraction(Decimal(f"{'-' * negative}{whole or '0'}.{fraction or '0'}e{exponent}"))
    a, b = k.edges(s)
    return _judge(value, exact, door, c, a, b - a)


def checked_from_f64(x: float, door: Door, c: Constraints):
    if door.is_integer:
        value = k.int_from_f64(x, door)
        exact = Fraction(value)
    elif door == Door.DECIMAL:
        value = k.decimal_from_f64(x)
        exact = Fraction(value[0], 10 ** value[1]) * (-1 if value[2] else 1)
    else:
        if x != x:
            raise k.Fault("malformed", "not_finite")
        if x in (float("inf"), float("-inf")):
            raise k.Fault("out_of_range", "not_finite")
        value = k.f32_from_f64(x) if door == Door.F32 else x + 0.0
        exact = Fraction(repr(x))
    return _judge(value, exact, door, c, 0, 0)


def _text(s: str, c: Constraints):
    k.cast_text(s)
    a, b = 0, len(s)
    if c.trim:
        a, b = k.edges(s)
        if a == b:
            raise k.Fault("empty", "blank")
    text = s[a:b]
    if c.min_length is not None and len(text) < c.min_length:
        raise Violation("minLength", text, a, b - a)
    if c.max_length is not None and len(text) > c.max_length:
        raise Violation("maxLength", text, a, b - a)
    if c.enum is None:
        return text, False, None
    same = (lambda e: e == text) if c.case_sensitive else (lambda e, f=fold(text): fold(e) == f)
    index = next((i for i, e in enumerate(c.enum) if same(e)), None)
    if index is None:
        raise Violation("enum", text, a, b - a)
    return c.enum[index], False, index
