"""Closed code lists of verdicts and declarations. The numbers and names are fixed values."""

from __future__ import annotations

from enum import IntEnum, IntFlag

#: The 25 Unicode White_Space code points.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

REASONS = {"empty": 1, "malformed": 2, "out_of_range": 3}

DETAILS = {
    name: code
    for code, name in enumerate(
        "blank unexpected_character digit_expected delimiter_expected trailing_text no_digits sign_misplaced "
        "parentheses_unbalanced mark_repeated group_misplaced group_size group_in_fraction ambiguous_separator "
        "fraction_not_allowed field_width wrong_length component_missing not_recognized unknown_unit invalid_utf8 "
        "too_long not_finite not_whole negative_not_allowed too_large too_small too_precise date_field_out_of_range "
        "time_field_out_of_range outside_window nonexistent_date not_a_scalar".split(),
        1,
    )
}

KEYWORDS = ("minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "enum")

REFUSALS = {"keyword_not_for_door": 1, "multiple_of_not_positive": 5, "rounding_without_multiple_of": 6, "not_held_by_door": 8, "enum_not_utf8": 9, "malformed_layout": 11}


class Door(IntEnum):
    BOOL, CHAR, I8, I16, I32, I64, U8, U16, U32, U64, F32, F64, DECIMAL, UUID, TIMESTAMP, UNIX, DATE, TIME, DURATION, TEXT, DATE_ORDERED, DATETIME, EXCEL_SERIAL = range(1, 24)

    @property
    def is_integer(self) -> bool:
        return Door.I8 <= self <= Door.U64

    @property
    def is_numeric(self) -> bool:
        return Door.I8 <= self <= Door.DECIMAL


class Flags(IntFlag):
    GROUPING = 1
    PARENS = 2
    EXPONENT = 4
    RADIX_PREFIX = 8
    PERCENT = 16
    SEPARATOR_DETECT = 32
    CURRENCY = 64
    TRAILING_SIGN = 128
    ALL = 1 | 2 | 4 | 8 | 16 | 64


class Grouping(IntEnum):
    WESTERN = 0
    INDIAN = 512


class UnixPrecision(IntEnum):
    SECONDS, MILLIS, MICROS, NANOS = 1, 2, 3, 4

    @property
    def per_second(self) -> int:
        return 1000 ** (self - 1)


class ExcelEpoch(IntEnum):
    E1900, E1904 = 1, 2


class DateOrder(IntEnum):
    YMD, MDY, DMY = 1, 2, 3


class Rounding(IntEnum):
    STRICT, MIDPOINT, FLOOR, CEILING = 0, 1, 2, 3


class DateFlags(IntFlag):
    COMPACT_DATE = 1
    SPACE_SEPARATOR = 2
    HOUR_OFFSET = 4
    COMMON_FORMS = 7


INT_RANGES = {
    Door.I8: (-(1 << 7), (1 << 7) - 1, 8), Door.I16: (-(1 << 15), (1 << 15) - 1, 16), Door.I32: (-(1 << 31), (1 << 31) - 1, 32), Door.I64: (-(1 << 63), (1 << 63) - 1, 64),
    Door.U8: (0, (1 << 8) - 1, 8), Door.U16: (0, (1 << 16) - 1, 16), Door.U32: (0, (1 << 32) - 1, 32), Door.U64: (0, (1 << 64) - 1, 64),
}
