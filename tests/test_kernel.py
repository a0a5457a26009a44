"""Values, reasons, details and spans of each door, and lane N against lane K."""

from decimal import Decimal

import pytest

from plumbline import kernel as k
from plumbline.checked import Violation, cast_checked, checked_from_f64
from plumbline.codes import WHITE_SPACE, DateFlags, DateOrder, Door, ExcelEpoch, Flags, Grouping, Rounding, UnixPrecision
from plumbline.declarations import DETECT, INVARIANT, Constraints, DateOptions, DayPeriods, MonthNames, NumFormat, declared_decimal, fold

DOLLAR = INVARIANT.with_currency("$")


def got(f, *a):
    try:
        return f(*a)
    except k.Fault as e:
        return e.args
    except Violation as e:
        return e.keyword


@pytest.mark.parametrize("text,want", [
    ("1,234", 1234), ("(1,234)", -1234), ("-$5", -5), ("$-5", -5), ("5$", 5), ("0xFF", 255), ("0xFFFFFFFF", -1), ("&H10", 16), ("0b101", 5), ("1e3", 1000), (" 7 ", 7),
    ("", ("empty", "blank", 0, 0)), ("1,23", ("malformed", "group_size", 1, 3)), ("12a", ("malformed", "unexpected_character", 2, 1)),
    ("+", ("malformed", "no_digits", 0, 1)), ("--5", ("malformed", "sign_misplaced", 1, 1)), ("1.5", ("malformed", "fraction_not_allowed", 1, 1)),
    ("99999999999", ("out_of_range", "too_large", 0, 11)), ("-99999999999", ("out_of_range", "too_small", 0, 12)), ("(5", ("malformed", "parentheses_unbalanced", 0, 2)),
    ("nan", ("malformed", "not_finite", 0, 1)), ("1e-2", ("malformed", "fraction_not_allowed", 2, 1)), ("1e", ("malformed", "digit_expected", 1, 1)), ("1,,234", ("malformed", "group_misplaced", 1, 1)),
])
def test_i32(text, want):
    assert got(k.cast_int, text, Door.I32, DOLLAR) == want


def test_other_numbers():
    assert got(k.cast_int, "-1", Door.U8) == ("out_of_range", "negative_not_allowed", 0, 2)
    assert k.cast_int("-0", Door.U8) == 0
    assert k.cast_int("12,34,567", Door.I64, INVARIANT.with_grouping(Grouping.INDIAN)) == 1234567
    assert k.cast_int("1.234.567", Door.I64, DETECT) == 1234567
    assert got(k.cast_int, "1,234", Door.I64, DETECT) == ("malformed", "ambiguous_separator", 1, 1)
    assert k.cast_float("2.5%", Door.F64) == 0.025 and k.cast_float("(2.5)%", Door.F64) == -0.025
    assert got(k.cast_float, "1e400", Door.F64) == ("out_of_range", "too_large", 0, 5)
    assert str(k.cast_float("-0", Door.F64)) == "0.0"
    assert got(k.cast_float, "1.2.3", Door.F64) == ("malformed", "mark_repeated", 3, 1)
    assert k.cast_decimal("1,234.5600", INVARIANT) == (123456, 2, False)
    assert got(k.cast_decimal, "0." + "1" * 29) == ("out_of_range", "too_precise", 0, 31)
    assert got(k.cast_decimal, "9" * 30) == ("out_of_range", "too_large", 0, 30)
    assert k.cast_int("١٢", Door.I32, INVARIANT.with_digits("٠")) == 12
    assert k.cast_int("5-", Door.I32, INVARIANT.with_flags(Flags.ALL | Flags.TRAILING_SIGN)) == -5


def test_words_and_ids():
    assert k.cast_bool(" YES ") is True and k.cast_bool("off") is False
    assert got(k.cast_bool, "\x11")[1] == "not_recognized"  # not in the lexicon
    assert [k.cast_char(x) for x in ("A", " ", "65", "U+41", "0x41", "&#65;", "&#x41;")] == ["A", " ", "A", "A", "A", "A", "A"]
    assert got(k.cast_char, "U+D800")[1] == "not_a_scalar" and got(k.cast_char, "U+G") == ("malformed", "digit_expected", 2, 1)
    u = "01020304-0506-0708-090a-0b0c0d0e0f10"
    for form in (u, u.upper(), u.replace("-", ""), f"{{{u}}}", f"({u})", f"urn:uuid:{u}", "{0x01020304,0x0506,0x0708,{0x9,0x0a,0x0b,0x0c,0x0d,0x0e,0x0f,0x10}}"):
        assert k.cast_uuid(form) == u
    assert got(k.cast_uuid, "uuid:") == ("malformed", "component_missing", 0, 5)
    assert len(WHITE_SPACE) == 25 and fold("Straße") == "straße"


def test_dates():
    assert got(k.cast_date, "2026-13-01") == ("out_of_range", "date_field_out_of_range", 5, 2)
    assert got(k.cast_date, "2026-1-7")[1] == "wrong_length"
    assert str(k.cast_date("20260107", DateOptions(DateFlags.COMPACT_DATE))) == "2026-01-07"
    assert str(k.cast_date_ordered("7.1.2026", DateOrder.DMY)) == "2026-01-07" == str(k.cast_date_ordered("2026/1/7", DateOrder.MDY))
    assert got(k.cast_date_ordered, "13/1/2026x", DateOrder.MDY) == ("malformed", "trailing_text", 9, 1)  # shape before value
    assert got(k.cast_date_ordered, "1/7-2026", DateOrder.MDY) == ("malformed", "delimiter_expected", 3, 1)
    assert str(k.cast_date_ordered("1/7/30", DateOrder.MDY, DateOptions(pivot=2029))) == "1930-01-07"
    names = MonthNames(tuple((n, w) for n, w in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)))
    assert str(k.cast_date_ordered("7-JAN-2026", DateOrder.DMY, DateOptions(months=names))) == "2026-01-07"
    assert k.cast_datetime("1/7/2026 3:04 PM", DateOrder.MDY)[1] == 54240 * 10**9
    assert k.cast_datetime("1/7/2026 nachm. 3:04", DateOrder.MDY, DayPeriods("vorm.", "nachm."))[1] == 54240 * 10**9
    assert got(k.cast_datetime, "1/7/2026 13:00 am", DateOrder.MDY)[1] == "time_field_out_of_range"
    assert k.cast_timestamp("2026-01-07T03:04:05.5+05:00") == (1767737045, 500_000_000)
    assert got(k.cast_timestamp, "2026-01-07T23:59:60Z") == ("out_of_range", "time_field_out_of_range", 17, 2)
    assert got(k.cast_timestamp, "2026-01-07T03:04:05") == ("malformed", "component_missing", 0, 19)
    assert k.cast_unix("-1", UnixPrecision.MILLIS) == (-1, 999_000_000)
    assert got(k.cast_time, "24:00")[1] == "time_field_out_of_range"
    assert got(k.cast_excel_serial, "60", ExcelEpoch.E1900)[1] == "nonexistent_date"
    assert k.cast_excel_serial("45000.5", ExcelEpoch.E1900) == (1678881600, 0)


def test_durations():
    assert k.cast_duration("PT1H30M") == (5400, 0) == k.cast_duration("01:30:00") == k.cast_duration("5400s")
    assert k.cast_duration("-3.5s") == (-3, -500_000_000)
    assert got(k.cast_duration, "P1Y") == ("malformed", "unknown_unit", 2, 1)
    assert got(k.cast_duration, "1.s") == ("malformed", "digit_expected", 1, 1)
    assert got(k.cast_duration, "1234567890123456789s") == ("malformed", "too_long", 18, 1)


def test_typed():
    assert k.decimal_from_f64(1e23) == (10**23, 0, False) and k.decimal_from_f64(0.1) == (1, 1, False)
    assert got(k.int_from_f64, 0.5, Door.I8)[1] == "not_whole" and got(k.decimal_from_f64, float("nan"))[1] == "not_finite"
    assert k.int_from_f64(2.0**60, Door.I64) == 1152921504606847000
    for seconds in range(0, 86400, 37):
        assert k.excel_serial_from_f64(45000 + seconds / 86400, ExcelEpoch.E1900) == (1678838400 + seconds, 0)
    assert k.excel_duration(-0.5) == (-43200, 0)


def test_checked():
    c = Constraints(multiple_of="0.05", rounding=Rounding.MIDPOINT, minimum=-90, maximum=90).check(Door.F64)
    assert cast_checked("1.234", Door.F64, c) == (1.25, True, None)
    assert got(cast_checked, "91", Door.F64, c) == "maximum"
    assert got(cast_checked, "0.99999999999", Door.F32, Constraints(exclusive_maximum=1).check(Door.F32)) == "exclusiveMaximum"
    assert got(cast_checked, "7", Door.I8, Constraints(multiple_of=2).check(Door.I8)) == "multipleOf"
    assert cast_checked(" RED ", Door.TEXT, Constraints(trim=True, enum=("blue", "red")).check(Door.TEXT)) == ("red", False, 1)
    assert checked_from_f64(0.3, Door.DECIMAL, Constraints(enum=("0.3",)).check(Door.DECIMAL)) == ((3, 1, False), False, None)
    for door, bad in ((Door.I32, Constraints(trim=True)), (Door.I32, Constraints(multiple_of=0)), (Door.I32, Constraints(rounding=Rounding.FLOOR)), (Door.BOOL, Constraints(minimum=1))):
        with pytest.raises(ValueError):
            bad.check(door)
    for bad in (dict(decimal_sep=","), dict(decimal_sep="1"), dict(currency=" $"), dict(flags=512)):
        with pytest.raises(ValueError):
            NumFormat(**bad)


TEXTS = ["", " ", "1", "-1", "+12", "1,234", "1,23", "12.5", ".5", "5.", "1e3", "true", "off", "2026-01-07", "2026-02-30", "0000-01-01", "1/7/2026", "13/1/2026", "1-7-2026", "1/7-2026", "12:30", "24:00", "12:30:59", "2026-01-07T03:04:05Z",
         "2026-01-07t03:04:05z", "2026-01-07T24:04:05Z", "999999999999", "99999999999999999999", "-0", "01020304-0506-0708-090a-0b0c0d0e0f10", "  7​", " 7　", "x", "1\n", "é", "0x1F", "(5)"]


def test_lanes_agree(spark):
    from plumbline.functions import doors as d

    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    doors = [Door.BOOL, Door.I8, Door.I32, Door.I64, Door.U64, Door.F64, Door.UUID, Door.TIMESTAMP, Door.DATE, Door.TIME, Door.TEXT]
    both = [d.cast_door("t", x, native=n).alias(f"{x.name}_{n}") for x in doors for n in (True, False)]
    both += [d.cast_date_ordered("t", DateOrder.MDY, native=n).alias(f"o_{n}") for n in (True, False)] + [d.cast_unix("t", UnixPrecision.MICROS, native=n).alias(f"u_{n}") for n in (True, False)]
    for r in df.select("t", *both).collect():
        for name in [x.name for x in doors] + ["o", "u"]:
            assert r[f"{name}_True"] == r[f"{name}_False"], (name, r.t)


def test_checked_lanes_agree_and_refuse_on_the_driver(spark):
    from plumbline.functions import doors as d

    df = spark.createDataFrame([(t,) for t in [*TEXTS, "7", "2.50", "-3.75", "1000001", "9" * 40, None]], "t string")
    cases = [(Door.I32, Constraints(minimum=-2, maximum=100, enum=(7, 1, "12"))), (Door.I64, Constraints(multiple_of=7)), (Door.DECIMAL, Constraints(exclusive_minimum="-3.75", maximum="12.5")), (Door.DECIMAL, Constraints(maximum="79228162514264337593543950335"))]
    both = [d.cast_checked("t", door, c, native=n).alias(f"c{i}_{n}") for i, (door, c) in enumerate(cases) for n in (True, False)]
    for r in df.select("t", *both).collect():
        for i in range(len(cases)):
            assert r[f"c{i}_True"] == r[f"c{i}_False"], (i, r.t)
            assert r[f"c{i}_True"] is None or r[f"c{i}_True"].enum_index is None
    seven = Constraints(enum=(7,))
    assert seven.check(Door.I32).enum == (Decimal(7),) and seven.enum == (7,)  # as it was
    for door, c in ((Door.UNIX, seven), (Door.DATETIME, Constraints(minimum=1))):
        with pytest.raises(ValueError):
            d.cast_checked("t", door, c)
    got = df.select(d.cast_checked("t", Door.UNIX, Constraints(), precision=UnixPrecision.SECONDS).alias("v")).where("v.ok").count()
    assert got > 0
    with pytest.raises(ValueError):
        d.checked_from_f64("t", Door.BOOL, Constraints())


def test_declared_numbers():
    for text, want in (("79228162514264337593543950335", 79228162514264337593543950335), ("-1.50", Decimal("-1.5")), ("1e28", 10**28), ("100e-2", 1), (".5", Decimal("0.5")), ("0e99999999999", 0), (Decimal("1E+3"), 1000)):
        assert declared_decimal(text) == want
    for text in ("79228162514264337593543950336", "1e29", "1e-29", " 1", "1 ", "1_000", "١", "", ".", "+", "1e", "1,5", "0x10", "NaN", "1e99999999999", 1.5, True):
        with pytest.raises(ValueError):
            declared_decimal(text)
    fmt = NumFormat.from_localeconv({"decimal_point": ",", "thousands_sep": ".", "mon_decimal_point": ".", "mon_thousands_sep": ",", "currency_symbol": "X "})
    assert k.cast_decimal("X 1,234.5", fmt) == (12345, 1, False) and k.cast_decimal("1.234,5", fmt) == (12345, 1, False)


def test_typed_lanes(spark):
    from plumbline.functions import doors as d

    xs = [0.0, -0.0, 1.0, -1.0, 0.5, 1.5, 60.0, 59.0, 0.1, 0.25, 1e-7, 123456.789, 2.0**53, 2.0**60, 1e23, -1e300, 3e38, 4e38, 45000 + 1 / 86400, 45000.123456789, 2958465.999, 2958466.0, 3000000.0, -0.25, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    doors = [Door.I8, Door.I64, Door.U8, Door.U64, Door.F32, Door.BOOL, Door.DECIMAL, Door.UNIX, Door.EXCEL_SERIAL]
    parse = {Door.F32: k.f32_from_f64, Door.BOOL: k.bool_from_f64, Door.DECIMAL: k.decimal_from_f64, Door.UNIX: lambda x: k.unix_from_f64(x, UnixPrecision.SECONDS), Door.EXCEL_SERIAL: lambda x: k.excel_serial_from_f64(x, ExcelEpoch.E1900)}
    for door in doors:
        f = parse.get(door, lambda x, door=door: k.int_from_f64(x, door))
        for r in df.select("x", d.from_f64("x", door).alias("v")).collect():
            want = got(f, r.x)
            if isinstance(want, tuple) and len(want) == 4:
                assert (r.v.ok, r.v.reason, r.v.detail) == (False, *want[:2]), (door, r.x, r.v)
            else:
                value = r.v["value"]
                value = (int(value.magnitude), value.scale, value.negative) if door == Door.DECIMAL else tuple(value) if isinstance(value, tuple) else value
                assert value == want, (door, r.x)
    for f, exact in ((d.excel_time, k.excel_time), (d.excel_duration, k.excel_duration)):
        for r in df.select("x", f("x").alias("v")).collect():
            want = got(exact, r.x)
            assert (r.v.detail == want[1]) if isinstance(want, tuple) and len(want) == 4 else (tuple(r.v["value"]) if isinstance(want, tuple) else r.v["value"]) == want, (r.x, r.v)


def test_spark_types(spark):
    from plumbline.functions import doors as d

    df = spark.createDataFrame([("2026-01-07T03:04:05.1234567Z", "1/7/2026 3:04:05 PM", "-1.02:03:04.5")], "i string, c string, s string")
    row = df.select(
        d.as_timestamp(d.cast_timestamp("i")["value"]).cast("string").alias("i"), d.as_timestamp_ntz(d.cast_datetime("c", DateOrder.MDY)["value"]).cast("string").alias("c"), d.as_interval(d.cast_duration("s")["value"]).alias("s"),
    ).first()
    assert (row.i, row.c) == ("2026-01-07 03:04:05.123456", "2026-01-07 15:04:05") and row.s.total_seconds() == -93784.5


def test_spans_stay_inside():
    for t in TEXTS:
        for n in range(len(t) + 1):
            for f in (k.cast_bool, k.cast_char, k.cast_uuid, k.cast_timestamp, k.cast_date, k.cast_time, k.cast_duration, lambda s: k.cast_int(s, Door.I32), lambda s: k.cast_float(s, Door.F64), k.cast_decimal, lambda s: k.cast_datetime(s, DateOrder.MDY), lambda s: k.cast_excel_serial(s, ExcelEpoch.E1900)):
                out = got(f, t[:n])
                if isinstance(out, tuple) and len(out) == 4:
                    assert 0 <= out[2] and out[2] + out[3] <= n


def test_binary_spans(spark):
    from plumbline.functions import doors as d

    df = spark.createDataFrame([(bytearray(b"\xc3\xa91"),), (bytearray(b"1\xff"),)], "b binary")
    a, b = (r.v for r in df.select(d.cast_i32("b", native=False).alias("v")).collect())
    assert (a.offset, a.length, a.detail) == (0, 2, "unexpected_character") and (b.offset, b.length, b.detail) == (1, 1, "invalid_utf8")


def test_stream_equals_batch(spark, tmp_path):
    from plumbline.streaming import cast_stream

    spark.createDataFrame([(t,) for t in TEXTS], "t string").write.parquet(str(tmp_path / "in"))
    doors = {"t": dict(door=Door.I32)}
    stream = cast_stream(spark.readStream.schema("t string").parquet(str(tmp_path / "in")), doors)
    q = stream.writeStream.format("memory").queryName("cast").start()
    q.processAllAvailable()
    q.stop()
    batch = cast_stream(spark.read.parquet(str(tmp_path / "in")), doors)
    assert sorted(map(repr, spark.table("cast").collect())) == sorted(map(repr, batch.collect()))
