"""Texts that each door refuses, one or more for every way that it can, and what it says of them; and texts it reads.

A row is (text, reason, detail, offset, length); R where the reason is out_of_range, malformed otherwise. Rows of a door
that a longer declaration reads stand under the name of that declaration. VALUES has (text, value as text()) rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codes import DateFlags, DateOrder, Door, ExcelEpoch, Flags, UnixPrecision
from ..declarations import DETECT, INVARIANT, DateOptions, DayPeriods, MonthNames
from ..functions import doors as d

MONTHS = MonthNames(tuple((n, w) for n, w in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)) + ((3, "mar."), (9, "sept")))
TRAILING = INVARIANT.with_currency("kr").with_flags(Flags.ALL | Flags.TRAILING_SIGN)
R = "out_of_range"


@dataclass(frozen=True)
class Site:
    name: str
    door: Door
    rows: tuple
    how: dict = field(default_factory=dict)

    def all(self) -> list[tuple[str, str, str, int, int]]:
        """Rows in full, white space alone among them."""
        out = [] if self.door == Door.TEXT else [("", "empty", "blank", 0, 0), (" 　\t", "empty", "blank", 0, 0)]
        for text, *more in self.rows:
            reason = more.pop(0) if more[0] == R else "malformed"
            out.append((text, reason, *more))
        return out


_REALS = (
    ("%", "no_digits", 0, 1), ("(5", "parentheses_unbalanced", 0, 2), ("( )", "parentheses_unbalanced", 0, 3), ("(-5)", "sign_misplaced", 1, 1), ("1.2.3", "mark_repeated", 3, 1), ("1.2,3", "group_in_fraction", 3, 1),
    (",1", "group_misplaced", 0, 1), ("1,,234", "group_misplaced", 1, 1), ("1,23", "group_size", 1, 3), ("1,23x", "group_size", 1, 3), ("0,123", "group_size", 0, 1), ("1234,567", "group_size", 0, 4), ("1e", "digit_expected", 1, 1), ("1e+", "digit_expected", 1, 1),
    ("1e5-", "sign_misplaced", 3, 1), ("1e5,000", "group_in_fraction", 3, 1), ("1e5x", "unexpected_character", 3, 1), ("--5", "sign_misplaced", 1, 1), ("NaN", "not_finite", 0, 1), ("-Infinity", "not_finite", 1, 1), ("1 2", "unexpected_character", 1, 1),
    ("1_0", "unexpected_character", 1, 1), ("1é", "unexpected_character", 1, 1), ("+", "no_digits", 0, 1), (".", "no_digits", 0, 1), ("  -  ", "no_digits", 2, 1), ("1\x00", "unexpected_character", 1, 1), ("5%%", "unexpected_character", 1, 1),
)
_ORDERED = (
    ("/7/2026", "digit_expected", 0, 1), ("1/", "digit_expected", 2, 0), ("1/x/2026", "digit_expected", 2, 1), ("12345/1/2026", "field_width", 0, 5), ("1_7_2026", "delimiter_expected", 1, 1), ("1", "delimiter_expected", 1, 0), ("1/7-2026", "delimiter_expected", 3, 1),
    ("1/7", "delimiter_expected", 3, 0), ("123/7/2026", "field_width", 0, 3), ("1/777/2026", "field_width", 2, 3), ("1/7/26", "field_width", 4, 2), ("1/7/126", "field_width", 4, 3), ("20260107", "field_width", 0, 8), ("1234567890123456789/1/1", "too_long", 18, 1),
    ("13/1/2026", R, "date_field_out_of_range", 0, 2), ("2/30/2026", R, "date_field_out_of_range", 2, 2), ("1/7/0000", R, "date_field_out_of_range", 4, 4), ("é/1/2026", "digit_expected", 0, 1), ("1/7/2026/", "trailing_text", 8, 1),
)

SITES = [
    Site("bool", Door.BOOL, (("maybe", "not_recognized", 0, 5), (" checKed ", "not_recognized", 1, 7), ("１", "not_recognized", 0, 1), ("1" * 5000, "not_recognized", 0, 5000), ("1\x00", "not_recognized", 0, 2))),
    Site("char", Door.CHAR, (
        ("& ", "delimiter_expected", 0, 1), (" & ", "delimiter_expected", 1, 1), ("&x41", "delimiter_expected", 1, 1), ("AB", "unexpected_character", 0, 1), (" A ", "unexpected_character", 1, 1), ("U+G1", "digit_expected", 2, 1), ("&#;", "digit_expected", 2, 1),
        ("0x", "no_digits", 0, 2), ("&#", "no_digits", 0, 2), ("&#65", "delimiter_expected", 0, 4), ("&#65x", "unexpected_character", 4, 1), ("&#65;x", "trailing_text", 5, 1), ("65x", "unexpected_character", 2, 1), ("U+00é9", "unexpected_character", 4, 1),
        ("U+110000", R, "not_a_scalar", 0, 8), ("&#55296;", R, "not_a_scalar", 0, 8), ("9" * 5000, R, "not_a_scalar", 0, 5000),
    )),
    Site("i32", Door.I32, (
        ("99999999999", R, "too_large", 0, 11), ("-99999999999", R, "too_small", 0, 12), ("0x", "no_digits", 0, 2), ("0xG", "digit_expected", 2, 1), ("0b2", "digit_expected", 2, 1), ("0x1FFFFFFFF", R, "too_large", 0, 11), ("1.5", "fraction_not_allowed", 1, 1),
        ("1e-2", "fraction_not_allowed", 2, 1), ("1e+-2", "fraction_not_allowed", 3, 1), ("5%", "unexpected_character", 1, 1), ("1e400", R, "too_large", 0, 5), ("-1e400", R, "too_small", 0, 6), ("9" * 5000, R, "too_large", 0, 5000), ("-" + "9" * 5000, R, "too_small", 0, 5001), ("1e" + "9" * 5000, R, "too_large", 0, 5002),
    ) + tuple(r for r in _REALS if r[0] not in ("%", "1.2.3", "1.2,3", ".", "5%%"))),
    Site("u8", Door.U8, (("256", R, "too_large", 0, 3), ("-1", R, "negative_not_allowed", 0, 2), ("(1)", R, "negative_not_allowed", 0, 3), ("-" + "9" * 5000, R, "negative_not_allowed", 0, 5001), ("-1e99", R, "negative_not_allowed", 0, 5))),
    Site("detect", Door.I64, (("1,234", "ambiguous_separator", 1, 1), ("1234,567", "ambiguous_separator", 4, 1), ("012,345", "ambiguous_separator", 3, 1), (",345", "ambiguous_separator", 0, 1), ("1.234,5", "fraction_not_allowed", 5, 1)), {"fmt": DETECT}),
    Site("money", Door.DECIMAL, (
        ("kr", "no_digits", 0, 2), ("(kr )", "no_digits", 1, 2), ("-kr-5", "sign_misplaced", 3, 1), ("(-kr5)", "sign_misplaced", 1, 1), ("-5-", "sign_misplaced", 2, 1), ("(5-)", "sign_misplaced", 2, 1), ("-5%-", "sign_misplaced", 3, 1), ("5kr-%-", "sign_misplaced", 3, 1), ("kr5kr", "unexpected_character", 3, 1),
    ), {"fmt": TRAILING}),
    Site("f64", Door.F64, _REALS + (("1e400", R, "too_large", 0, 5), ("9" * 5000, R, "too_large", 0, 5000), ("(" + "0" * 300 + ")", "too_long", 0, 302), ("1e" + "9" * 5000, R, "too_large", 0, 5002))),
    Site("f32", Door.F32, (("1e39", R, "too_large", 0, 4), ("x", "unexpected_character", 0, 1))),
    Site("decimal", Door.DECIMAL, _REALS + (("79228162514264337593543950336", R, "too_large", 0, 29), ("79228162514264337593543950335.5", R, "too_precise", 0, 31), ("1e-29", R, "too_precise", 0, 5), ("1e29", R, "too_large", 0, 4), ("9" * 5000, R, "too_large", 0, 5000))),
    Site("uuid", Door.UUID, (
        ("guid: ", "component_missing", 0, 5), ("0102", "wrong_length", 0, 4), ("{0102}", "wrong_length", 0, 6), ("01020304-0506-0708-090a-0b0c0d0e0f1g", "digit_expected", 35, 1), ("01020304_0506-0708-090a-0b0c0d0e0f10", "delimiter_expected", 8, 1),
        ("{01020304-0506-0708-090a-0b0c0d0e0f10)", "delimiter_expected", 37, 1), ("0102030405060708090a0b0c0d0e0f1g", "digit_expected", 31, 1), ("{0x01020304;", "delimiter_expected", 11, 1), ("{0x1", "delimiter_expected", 0, 4), ("{0x1,05", "delimiter_expected", 5, 1),
        ("{0x010203040", "field_width", 11, 1), ("{0x,", "digit_expected", 3, 1), ("{0x1,0x2,0x3,{0x1,0x2,0x3,0x4,0x5,0x6,0x7,0x8}}x", "trailing_text", 47, 1), ("é" * 18, "delimiter_expected", 4, 1), ("f" * 5000, "wrong_length", 0, 5000),
    )),
    Site("timestamp", Door.TIMESTAMP, (
        ("2026-01-07", "wrong_length", 0, 10), ("2026-01-07_15:04:05Z", "delimiter_expected", 10, 1), ("20x6-01-07T15:04:05Z", "digit_expected", 0, 4), ("2026/01-07T15:04:05Z", "delimiter_expected", 4, 1), ("2026-1-07T15:04:05Z", "digit_expected", 5, 2), ("2026-01/07T15:04:05Z", "delimiter_expected", 7, 1), ("2026-01-7T15:04:05Z", "digit_expected", 8, 2),
        ("2026-01-07T5:04:05Z", "digit_expected", 11, 8), ("2026-01-07T15-04:05Z", "delimiter_expected", 11, 9), ("2026-01-07T15:04", "component_missing", 11, 5), ("2026-01-07T15:04Z", "component_missing", 11, 6), ("2026-01-07T15:04.5Z", "delimiter_expected", 11, 8),
        ("2026-01-07T15:0x:05Z", "digit_expected", 14, 2), ("2026-01-07T15:04:5", "digit_expected", 17, 1), ("2026-01-07T15:04:05", "component_missing", 0, 19), ("2026-01-07T15:04:05.Z", "digit_expected", 19, 1), ("2026-01-07T15:04:05Zx", "trailing_text", 20, 1), ("2026-01-07T15:04:05+1", "digit_expected", 20, 1),
        ("2026-01-07T15:04:05+01", "delimiter_expected", 22, 0), ("2026-01-07T15:04:05+0100", "delimiter_expected", 22, 1), ("2026-01-07T15:04:05+01:0", "digit_expected", 23, 1), ("2026-01-07T15:04:05+01:00x", "trailing_text", 25, 1), ("2026-01-07T15:04:05x", "unexpected_character", 19, 1), ("2026-13-07T15:04:05Z", R, "date_field_out_of_range", 5, 2),
        ("2026-01-07T24:04:05Z", R, "time_field_out_of_range", 11, 2), ("2026-01-07T15:60:05Z", R, "time_field_out_of_range", 14, 2), ("2026-01-07T15:04:60Z", R, "time_field_out_of_range", 17, 2), ("2026-01-07T15:04:05+24:00", R, "time_field_out_of_range", 20, 2), ("2026-01-07T15:04:05+01:60", R, "time_field_out_of_range", 23, 2),
        ("0001-01-01T00:00:00+01:00", R, "outside_window", 0, 25), ("é026-01-07T15:04:05Z", "digit_expected", 0, 3),
    )),
    Site("timestamp_common", Door.TIMESTAMP, (("20260107T15:04:05Z", "delimiter_expected", 4, 1), ("2026-01-07 15:04:05+1", "digit_expected", 20, 1), ("2026-01-07_15:04:05Z", "delimiter_expected", 10, 1)), {"options": DateOptions(DateFlags.COMMON_FORMS)}),
    Site("unix", Door.UNIX, (("-", "no_digits", 0, 1), ("1.5", "fraction_not_allowed", 1, 1), ("1-", "sign_misplaced", 1, 1), ("1x", "unexpected_character", 1, 1), ("9" * 5000, R, "too_large", 0, 5000), ("1" + "0" * 30, R, "outside_window", 0, 31), ("-99999999999999", R, "outside_window", 0, 15)), {"precision": UnixPrecision.SECONDS}),
    Site("date", Door.DATE, (("2026-1-7", "wrong_length", 0, 8), ("2026 01-07", "delimiter_expected", 4, 1), ("x026-01-07", "digit_expected", 0, 4), ("2026-x1-07", "digit_expected", 5, 2), ("2026-01_07", "delimiter_expected", 7, 1), ("2026-01-0x", "digit_expected", 8, 2), ("0000-01-01", R, "date_field_out_of_range", 0, 4), ("2026-00-01", R, "date_field_out_of_range", 5, 2), ("2026-02-29", R, "date_field_out_of_range", 8, 2), ("é" * 10, "wrong_length", 0, 10), ("20260107", "wrong_length", 0, 8))),
    Site("time", Door.TIME, (("3:04", "digit_expected", 0, 2), ("1", "digit_expected", 0, 1), ("15-04", "delimiter_expected", 2, 1), ("15", "delimiter_expected", 2, 0), ("15:4", "digit_expected", 3, 1), ("15:", "digit_expected", 3, 0), ("15:04:5", "digit_expected", 6, 1), ("15:04.5", "trailing_text", 5, 1), ("15:04:05.", "digit_expected", 8, 1), ("15:04 :05", "trailing_text", 5, 1), ("24:00", R, "time_field_out_of_range", 0, 2), ("15:60", R, "time_field_out_of_range", 3, 2), ("15:04:60", R, "time_field_out_of_range", 6, 2))),
    Site("duration", Door.DURATION, (
        ("90m", "component_missing", 0, 3), ("s", "no_digits", 0, 1), ("-s", "no_digits", 0, 2), ("xs", "digit_expected", 0, 2), ("1s5s", "trailing_text", 1, 1), ("1xs", "unexpected_character", 1, 1), ("1.s", "digit_expected", 1, 1), ("P", "component_missing", 0, 1), ("P3DT", "component_missing", 0, 4), ("PT1HT1M", "mark_repeated", 4, 1), ("PX", "digit_expected", 1, 1),
        ("P1", "component_missing", 1, 1), ("P1Y", "unknown_unit", 2, 1), ("P1H", "unknown_unit", 2, 1), ("P1.5D", "fraction_not_allowed", 1, 4), (":30", "digit_expected", 0, 1), ("1.:30", "digit_expected", 2, 1), ("1.123:30", "field_width", 2, 3), ("123:30", "field_width", 0, 3), ("1x:30", "delimiter_expected", 1, 1), ("1:", "digit_expected", 2, 0), ("1:123", "field_width", 2, 3),
        ("1:30:", "digit_expected", 5, 0), ("1:30:123", "field_width", 5, 3), ("1:30x", "trailing_text", 4, 1), ("25:00:00", R, "time_field_out_of_range", 0, 2), ("1:60", R, "time_field_out_of_range", 2, 2), ("1234567890123456789s", "too_long", 18, 1), ("315576000001s", R, "outside_window", 0, 13), ("9" * 5000 + "s", "too_long", 18, 1),
    )),
    Site("date_ordered", Door.DATE_ORDERED, _ORDERED + (("1/7/2026x", "trailing_text", 8, 1),), {"order": DateOrder.MDY}),
    Site("date_months", Door.DATE_ORDERED, (
        ("jan-07-2026", "digit_expected", 0, 1), ("7-foo-2026", "not_recognized", 2, 3), ("7-jan/2026", "delimiter_expected", 5, 1), ("7-jan", "delimiter_expected", 5, 0), ("7--2026", "digit_expected", 2, 1), ("7-jan x-2026", "delimiter_expected", 5, 1), ("7-jé-2026", "not_recognized", 2, 2), ("7 jan 2026", "delimiter_expected", 1, 1),
        ("7-jan-26", "field_width", 6, 2), ("31-feb-2026", R, "date_field_out_of_range", 0, 2), ("7.mar..2026x", "trailing_text", 11, 1),
    ), {"order": DateOrder.DMY, "options": DateOptions(months=MONTHS)}),
    Site("datetime", Door.DATETIME, _ORDERED[:-1] + (
        ("1/7/2026x", "delimiter_expected", 8, 1), ("1/7/2026 3:04", "delimiter_expected", 8, 1), ("1/7/2026 x", "digit_expected", 9, 1), ("1/7/2026 PM", "digit_expected", 11, 0), ("1/7/2026 123:04", "field_width", 9, 3), ("1/7/2026 3:4", "digit_expected", 11, 1), ("1/7/2026 3:", "digit_expected", 11, 0),
        ("1/7/2026 3:04:5", "digit_expected", 14, 1), ("1/7/2026 3", "component_missing", 9, 1), ("1/7/2026 3:04 x", "trailing_text", 13, 1), ("1/7/2026 PM 3:04 PM", "trailing_text", 16, 1), ("1/7/2026 3:04:05.", "digit_expected", 16, 1), ("1/7/2026 24:00", R, "time_field_out_of_range", 9, 2), ("1/7/2026 13:04 pm", R, "time_field_out_of_range", 9, 2),
        ("1/7/2026 0:04 am", R, "time_field_out_of_range", 9, 1), ("1/7/2026 3:60", R, "time_field_out_of_range", 11, 2), ("1/7/2026 3:04:60", R, "time_field_out_of_range", 14, 2), ("1/7/2026 3:04 Nachm.", "trailing_text", 13, 1), ("2026-01-07T3:04+05", "trailing_text", 15, 1),
    ), {"order": DateOrder.MDY, "periods": DayPeriods("vorm.", "nachm.")}),
    Site("excel_serial", Door.EXCEL_SERIAL, (("-1", "negative_not_allowed", 0, 1), ("+1", "sign_misplaced", 0, 1), ("x", "digit_expected", 0, 1), (".5", "digit_expected", 0, 1), ("1.", "digit_expected", 1, 1), ("1 2", "trailing_text", 1, 1), ("1,5", "unexpected_character", 1, 1), ("60", R, "nonexistent_date", 0, 2), ("60.5", R, "nonexistent_date", 0, 4), ("0", R, "outside_window", 0, 1), ("2958466", R, "outside_window", 0, 7), ("9" * 5000, R, "too_large", 0, 5000)), {"epoch": ExcelEpoch.E1900}),
]

_U = "01020304-0506-0708-090a-0b0c0d0e0f10"
VALUES = {
    "bool": (("YES", "true"), (" t ", "true"), ("Off", "false"), ("unchecked", "false"), ("0", "false")),
    "char": (("A", "65"), (" ", "32"), ("7", "55"), ("65", "65"), ("u+1F600", "128512"), ("0X41", "65"), ("&h41", "65"), ("&#65;", "65"), ("&#x41;", "65"), (" 65 ", "65"), ("é", "233"), ("&#8364;", "8364")),
    "i32": (("1,234", "1234"), ("(1,234)", "-1234"), ("0xFFFFFFFF", "-1"), ("&H10", "16"), ("0b101", "5"), ("1e3", "1000"), ("1E+3", "1000"), ("+7", "7"), ("-0", "0"), ("0" * 5000, "0"), ("0" * 5000 + "7", "7"), ("0e" + "9" * 5000, "0"), ("007", "7"), ("2147483647", "2147483647")),
    "u8": (("255", "255"), ("-0", "0"), ("(0)", "0"), ("0xFF", "255")),
    "detect": (("1.234.567", "1234567"), ("1,234,567", "1234567"), ("12", "12")),
    "money": (("kr 1,234.50", "1234.5"), ("-kr5", "-5"), ("kr-5", "-5"), ("5 kr-", "-5"), ("5kr", "5"), ("5-", "-5"), ("(kr5)", "-5"), ("50%", "0.5"), ("5%-", "-0.05")),
    "f64": (("1.5", "1.5"), (".5", "0.5"), ("5.", "5.0"), ("-0", "0.0"), ("1,234.25", "1234.25"), ("50%", "0.5"), ("(2.5)%", "-0.025"), ("1e-400", "0.0"), ("1e22", "1.0E22"), ("9007199254740993", "9.007199254740992E15"), ("0.1%", "0.001"), ("1e-" + "9" * 5000, "0.0"), ("0." + "0" * 400 + "1e401", "1.0")),
    "f32": (("0.1", "0.1"), ("16777217", "1.6777216E7"), ("-0", "0.0"), ("1.5", "1.5"), ("1.00000017881393432617187499", "1.0000001")),
    "decimal": (("1,234.5600", "1234.56"), ("-0.0", "0"), ("79228162514264337593543950335", "79228162514264337593543950335"), ("1e-28", "0.0000000000000000000000000001"), ("100e-2", "1"), ("0.000001", "0.000001"), ("-.5", "-0.5"), ("12.5%", "0.125"), ("0" * 5000 + ".5", "0.5")),
    "uuid": tuple((x, _U) for x in (_U, _U.upper(), _U.replace("-", ""), f"{{{_U}}}", f"({_U})", f"URN:UUID:{_U}", f"guid: {_U}", "{0x01020304,0x0506,0x0708,{0x9,0x0a,0x0b,0x0c,0x0d,0x0e,0x0f,0x10}}")),
    "timestamp": (("2026-01-07T03:04:05Z", "1767755045:0"), ("2026-01-07t03:04:05.5+05:00", "1767737045:500000000"), ("2026-01-07T03:04:05.1234567899z", "1767755045:123456789"), ("1969-12-31T23:59:59.25-00:30", "1799:250000000"), ("0001-01-01T00:00:00Z", "-62135596800:0")),
    "timestamp_common": (("2026-01-07 03:04:05+05", "1767737045:0"), ("2026-01-07T03:04:05-05:30", "1767774845:0")),
    "unix": (("-1", "-1:0"), ("+12", "12:0"), ("0" * 5000 + "9", "9:0")),
    "date": (("2026-01-07", "2026-01-07"), (" 2024-02-29\n", "2024-02-29")),
    "time": (("15:04", "54240000000000"), ("15:04:05.5", "54245500000000"), ("00:00:00.0000000019", "1"), ("23:59:59", "86399000000000")),
    "duration": (("PT1H30M", "5400:0"), ("-3.5s", "-3:-500000000"), ("01:30:00", "5400:0"), ("1:30", "5400:0"), ("1.02:03:04,5", "93784:500000000"), ("P1W", "604800:0"), ("-p1dt2h", "-93600:0"), ("PT0.000000001S", "0:1"), ("315576000000s", "315576000000:0"), ("5400S", "5400:0")),
    "date_ordered": (("1/7/2026", "2026-01-07"), ("1.7.2026", "2026-01-07"), ("2026/1/7", "2026-01-07"), ("01-07-2026", "2026-01-07")),
    "date_months": (("7-JAN-2026", "2026-01-07"), ("7.mar.2026", "2026-03-07"), ("7.mar..2026", "2026-03-07"), ("2026-sept-07", "2026-09-07"), ("7/1/2026", "2026-01-07")),
    "datetime": (("1/7/2026 3:04 PM", "2026-01-07 54240000000000"), ("1/7/2026", "2026-01-07 0"), ("2026-01-07T15:04:05.5", "2026-01-07 54245500000000"), ("1/7/2026 nachm. 3:04", "2026-01-07 54240000000000"), ("1/7/2026 12am", "2026-01-07 0"), ("1/7/2026 3:04:05pm", "2026-01-07 54245000000000"), ("1/7/2026 3:04 vorm.", "2026-01-07 11040000000000")),
    "excel_serial": (("45000.5", "1678881600:0"), ("59", "-2203977600:0"), ("61", "-2203891200:0"), ("1", "-2208988800:0"), ("2958465.99999999999999", "253402300799:999999999"), ("45000.00000000000001", "1678838400:0")),
}


def text(door: Door, value: Column) -> Column:
    """A door's value as text that Spark and SQL write alike."""
    if door in (Door.TIMESTAMP, Door.UNIX, Door.DURATION, Door.EXCEL_SERIAL):
        return F.concat_ws(":", value["seconds"].cast("string"), value["nanos"].cast("string"))
    if door == Door.DATETIME:
        return F.concat_ws(" ", value["date"].cast("string"), value["nanos_of_day"].cast("string"))
    return (value["text"] if door == Door.DECIMAL else value["code_point"] if door == Door.CHAR else value).cast("string")


def verdicts(spark, site: Site, native: bool = True) -> DataFrame:
    """n, value, reason, detail, offset and length of the site's texts, refused ones first."""
    texts = [r[0] for r in site.all()] + [t for t, _ in VALUES.get(site.name, ())]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    v = F.col("v")
    got = rows.withColumn("v", d.cast_door("t", site.door, native=native, **site.how))
    return got.select("n", F.when(v["ok"], text(site.door, v["value"])).alias("value"), *[v[c].alias(c) for c in ("reason", "detail", "offset", "length")])


def sql(site: Site) -> str:
    say = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows = [(None, *r[1:]) for r in site.all()] + [(x, None, None, None, None) for _, x in VALUES.get(site.name, ())]
    lines = ", ".join(f"({n}, {', '.join(map(say, r))})" for n, r in enumerate(rows))
    return f"SELECT CAST(n AS INTEGER) AS n, CAST(value AS VARCHAR) AS value, CAST(reason AS VARCHAR) AS reason, CAST(detail AS VARCHAR) AS detail, CAST(o AS INTEGER) AS \"offset\", CAST(l AS INTEGER) AS length FROM (VALUES {lines}) AS x(n, value, reason, detail, o, l)"


def queries():
    return {f"sites_{s.name}": (lambda spark, sf_dir, s=s: verdicts(spark, s)) for s in SITES}


def oracle_sql():
    return {f"sites_{s.name}": sql(s) for s in SITES}
