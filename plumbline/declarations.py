"""Declarations of a cast. Each is checked when it is made, on the driver; a bad one raises ValueError."""

from __future__ import annotations

import locale
import re
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import lru_cache

from .codes import WHITE_SPACE, DateFlags, Door, Flags, Grouping, Rounding

#: Spaces that stand for one another as separators and inside currency symbols.
SPACES = " \xa0\u202f"


def fold(text: str) -> str:
    """Simple case folding: one code point to one, not Turkic."""
    return "".join(map(_fold_char, text))


#: Pairs that simple folding joins and neither casefold() nor lower() gives (fixed values).
_FOLDS = {"\u1fd3": "\u0390", "\u1fe3": "\u03b0", "\ufb05": "\ufb06"}


def _fold_char(c: str) -> str:
    if c in _FOLDS:
        return _FOLDS[c]
    for f in (c.casefold(), c.lower()):
        if len(f) == 1:
            return f
    return c


@dataclass(frozen=True)
class NumFormat:
    """How numerals are written: separators, signs, currency, percent, native digits and what is allowed."""

    flags: Flags = Flags.ALL
    decimal_sep: str = "."
    group_sep: str = ","
    currency: str = ""
    currency_decimal_sep: str = ""
    currency_group_sep: str = ""
    minus_sign: str = ""
    plus_sign: str = ""
    percent: str = ""
    digit_zero: str = ""
    grouping: Grouping = Grouping.WESTERN

    def __post_init__(self):
        if int(self.flags) & ~255:
            raise ValueError("unknown flags")
        object.__setattr__(self, "grouping", Grouping(self.grouping))
        for name in ("decimal_sep", "group_sep", "currency_decimal_sep", "currency_group_sep", "minus_sign", "plus_sign", "percent"):
            mark = getattr(self, name)
            if len(mark.encode()) > 8 or any("0" <= c <= "9" for c in mark):
                raise ValueError(f"{name}: at most 8 bytes and no digit")
            if "group" not in name and any(c in WHITE_SPACE for c in mark):
                raise ValueError(f"{name}: no white space")
        if not self.decimal_sep or not self.group_sep:
            raise ValueError("separators are needed")
        if _same(self.decimal_sep, self.group_sep) or self.currency_decimal_sep and _same(self.currency_decimal_sep, self.currency_group_sep or self.group_sep):
            raise ValueError("decimal and group separator are the same")
        if self.currency and (len(self.currency.encode()) > 16 or any("0" <= c <= "9" for c in self.currency) or self.currency.strip(WHITE_SPACE) != self.currency):
            raise ValueError("currency: at most 16 bytes, no digit, no white space at its edges")
        if self.digit_zero and (len(self.digit_zero) != 1 or ord(self.digit_zero) < 128 or self.digit_zero.encode()[:-1] != chr(ord(self.digit_zero) + 9).encode()[:-1]):
            raise ValueError("digit_zero: a digit zero above ASCII whose ten digits share a prefix")

    def has(self, flag: Flags) -> bool:
        return bool(self.flags & flag)

    def with_flags(self, flags: Flags) -> NumFormat:
        return replace(self, flags=flags)

    def with_separators(self, decimal: str, group: str) -> NumFormat:
        return replace(self, decimal_sep=decimal, group_sep=group)

    def with_currency(self, symbol: str) -> NumFormat:
        return replace(self, currency=symbol)

    def with_currency_separators(self, decimal: str, group: str) -> NumFormat:
        return replace(self, currency_decimal_sep=decimal, currency_group_sep=group)

    def with_signs(self, minus: str, plus: str = "") -> NumFormat:
        return replace(self, minus_sign=minus, plus_sign=plus)

    def with_percent(self, percent: str) -> NumFormat:
        return replace(self, percent=percent)

    def with_digits(self, zero: str) -> NumFormat:
        return replace(self, digit_zero=zero)

    def with_grouping(self, grouping: Grouping) -> NumFormat:
        return replace(self, grouping=grouping)

    @staticmethod
    def from_localeconv(conv: dict | None = None, flags: Flags = Flags.ALL) -> NumFormat:
        """The numeric and the monetary part of localeconv(); called on the driver, the result travels.

        Monetary separators are declared where they differ from the numeric ones.
        """
        c = locale.localeconv() if conv is None else conv
        decimal = c.get("decimal_point") or "."
        group = c.get("thousands_sep") or ("\xa0" if decimal != "." else ",")
        sizes = list(c.get("grouping") or ())
        indian = len(sizes) > 1 and sizes[:2] == [3, 2]
        symbol = (c.get("currency_symbol") or "").strip()
        money = [c.get("mon_decimal_point") or decimal, c.get("mon_thousands_sep") or group] if symbol else [decimal, group]
        if _same(*money):  # a locale that only names one of them
            money = [decimal, group]
        point, apart = (m if m != n else "" for m, n in zip(money, (decimal, group)))
        return NumFormat(flags, decimal, group, symbol, point, apart, grouping=Grouping.INDIAN if indian else Grouping.WESTERN)


def _same(a: str, b: str) -> bool:
    return a == b or a in SPACES and b in SPACES


INVARIANT = NumFormat()
DETECT = NumFormat(Flags.ALL | Flags.SEPARATOR_DETECT)


@dataclass(frozen=True)
class DayPeriods:
    """Words for morning and afternoon, as they are written, beside AM and PM; either may be left out."""

    am: str = ""
    pm: str = ""

    def __post_init__(self):
        for w in (self.am, self.pm):
            if w.strip(WHITE_SPACE) != w or any("0" <= c <= "9" for c in w) or len(w.encode()) > 16:
                raise ValueError("a day period has at most 16 bytes, no digit and no white space at its edges")


@dataclass(frozen=True)
class MonthNames:
    """(month, name) entries; all twelve months, folded, longest match."""

    entries: tuple[tuple[int, str], ...]

    def __post_init__(self):
        object.__setattr__(self, "entries", tuple((int(m), n) for m, n in self.entries))
        if {m for m, _ in self.entries} != set(range(1, 13)):
            raise ValueError("every month needs a name")
        for _, n in self.entries:
            if not n or len(n.encode()) > 64 or any("0" <= c <= "9" or c in "/-" or c in WHITE_SPACE for c in n):
                raise ValueError(f"not a month name: {n!r}")
        folded: dict[str, int] = {}
        for m, n in self.entries:
            if folded.setdefault(fold(n), m) != m or sum(fold(x) == fold(n) for _, x in self.entries) > 1:
                raise ValueError(f"two entries read alike: {n!r}")

    def longest_first(self) -> list[tuple[str, int]]:
        return _longest_first(self.entries)


@lru_cache(maxsize=64)
def _longest_first(entries: tuple[tuple[int, str], ...]) -> list[tuple[str, int]]:
    return sorted(((fold(n), m) for m, n in entries), key=lambda x: -len(x[0]))


@dataclass(frozen=True)
class DateOptions:
    """Optional forms: yyyyMMdd, a space before the time, an hour-only offset, two-digit years, month names."""

    flags: DateFlags = DateFlags(0)
    pivot: int = 0
    months: MonthNames | None = None

    def __post_init__(self):
        if int(self.flags) & ~7:
            raise ValueError("unknown flags")
        if self.pivot and not 100 <= self.pivot <= 9999:
            raise ValueError("pivot must be 0 or from 100 to 9999")

    def year(self, yy: int) -> int:
        """The year that ends in yy among the hundred up to the pivot."""
        return self.pivot - (self.pivot - yy) % 100


_DECLARED = re.compile(r"([+-]?)(?=\.?[0-9])([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?)([0-9]+))?")


def declared_decimal(value) -> Decimal:
    """An exact declared number: invariant notation, of at most 96 bits and scale 28 once trailing zeros are dropped."""
    if isinstance(value, bool) or isinstance(value, float):
        raise ValueError("declare numbers as int, str or Decimal")
    m = _DECLARED.fullmatch(str(value))
    if not m:
        raise ValueError(f"not a number in invariant notation: {value!r}")
    sign, whole, fraction, way, exponent = (x or "" for x in m.groups())
    digits = (whole + fraction).lstrip("0")
    kept = digits.rstrip("0")
    if not kept:
        return Decimal(0)
    exponent = exponent.lstrip("0")
    power = int(exponent or "0") if len(exponent) < 10 else 10**9
    power = (-power if way == "-" else power) - len(fraction) + len(digits) - len(kept)
    if len(kept) > 29 or power < -28 or len(kept) + power > 29 or int(kept) * 10 ** max(0, power) >= 1 << 96:
        raise ValueError(f"no decimal holds {value}")
    return Decimal((int(sign == "-"), tuple(map(int, kept)), power))


@dataclass(frozen=True)
class Constraints:
    """Validation keywords; None means not declared. Texts in enum at the text door, numbers elsewhere."""

    minimum: Decimal | None = None
    exclusive_minimum: Decimal | None = None
    maximum: Decimal | None = None
    exclusive_maximum: Decimal | None = None
    multiple_of: Decimal | None = None
    rounding: Rounding = Rounding.STRICT
    min_length: int | None = None
    max_length: int | None = None
    trim: bool = False
    case_sensitive: bool | None = None
    enum: tuple | None = field(default=None)

    def __post_init__(self):
        for name in ("minimum", "exclusive_minimum", "maximum", "exclusive_maximum", "multiple_of"):
            v = getattr(self, name)
            if v is not None:
                object.__setattr__(self, name, declared_decimal(v))
        object.__setattr__(self, "rounding", Rounding(self.rounding))
        if self.enum is not None:
            object.__setattr__(self, "enum", tuple(self.enum))

    def check(self, door: Door) -> Constraints:
        """These keywords as the door takes them, numbers exact; ValueError names the first rule broken."""
        step, rounds = self.multiple_of is not None, self.rounding != Rounding.STRICT
        if door.is_numeric:
            wrong = self.trim or self.case_sensitive is not None
        elif door == Door.TEXT:
            wrong = rounds and step
        else:
            wrong = self != Constraints()
        if wrong:
            raise ValueError("keyword_not_for_door")
        if step and self.multiple_of <= 0:
            raise ValueError("multiple_of_not_positive")
        if rounds and not step:
            raise ValueError("rounding_without_multiple_of")
        if door.is_integer and step and rounds and self.multiple_of != self.multiple_of.to_integral_value():
            raise ValueError("not_held_by_door")
        if door == Door.TEXT and any(not isinstance(x, str) for x in self.enum or ()):
            raise ValueError("enum_not_utf8")
        return replace(self, enum=tuple(declared_decimal(x) for x in self.enum)) if door.is_numeric and self.enum is not None else self
