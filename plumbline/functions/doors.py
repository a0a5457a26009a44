"""Doors as Column functions: each gives a verdict struct per row, null for null.

verdict: struct<value, ok, reason, offset, length, detail, detail_code>; checked doors add adjusted, enum_index and
keyword. Offsets and lengths are code points for string input and bytes for binary input; a byte of a string that is
no UTF-8 counts as one.

A regular shape that the declaration admits is read by native expressions (lane N, in lanes.py), and so are empty texts
and the faults of decoded numbers; the rest go to the exact kernel in Arrow batches (lane K), which sees null for the
rows that lane N took and parses each distinct text of a batch once.
"""

from __future__ import annotations

from decimal import Decimal
from functools import partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import kernel as k
from ..checked import Violation, cast_checked as _checked, checked_from_f64 as _checked_f64
from ..codes import DETAILS, INT_RANGES, DateOrder, Door, ExcelEpoch, Rounding, UnixPrecision
from ..declarations import INVARIANT, Constraints, DateOptions, DayPeriods, NumFormat
from . import lanes

_INSTANT = "struct<seconds:bigint,nanos:int>"
_DECIMAL = "struct<magnitude:decimal(29,0),scale:tinyint,negative:boolean,text:string>"

VALUE_TYPES = {
    Door.BOOL: "boolean", Door.CHAR: "struct<value:string,code_point:int>", Door.I8: "tinyint", Door.I16: "smallint", Door.I32: "int", Door.I64: "bigint",
    Door.U8: "smallint", Door.U16: "int", Door.U32: "bigint", Door.U64: "decimal(20,0)", Door.F32: "float", Door.F64: "double", Door.DECIMAL: _DECIMAL,
    Door.UUID: "string", Door.TIMESTAMP: _INSTANT, Door.UNIX: _INSTANT, Door.DATE: "date", Door.TIME: "bigint", Door.DURATION: _INSTANT, Door.TEXT: "string",
    Door.DATE_ORDERED: "date", Door.DATETIME: "struct<date:date,nanos_of_day:bigint>", Door.EXCEL_SERIAL: _INSTANT,
}


def _plain_value(v):
    return v


def _fields(*names):
    return lambda v: dict(zip(names, v))


def _decimal_value(v):
    return {"magnitude": Decimal(v[0]), "scale": v[1], "negative": v[2], "text": k.decimal_text(v)}


_TO_ROW = {Door.CHAR: lambda c: {"value": c, "code_point": ord(c)}, Door.DECIMAL: _decimal_value, Door.U64: Decimal, Door.DATETIME: _fields("date", "nanos_of_day")} | dict.fromkeys(
    (Door.TIMESTAMP, Door.UNIX, Door.DURATION, Door.EXCEL_SERIAL), _fields("seconds", "nanos")
)


def _schema(value: str, checked: bool = False) -> str:
    more = ",adjusted:boolean,enum_index:int,keyword:string" if checked else ""
    return f"struct<value:{value},ok:boolean,reason:string,offset:int,length:int,detail:string,detail_code:int{more}>"


def _kernel(parse, value_type: str, to_row=_plain_value, checked: bool = False):
    """An Arrow function from texts (string or binary) or doubles to verdict structs."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T._parse_datatype_string(_schema(value_type, checked))
    arrow = to_arrow_type(schema)

    def run(column: pa.Array) -> pa.Array:
        if column.null_count == len(column):
            return pa.nulls(len(column), arrow)
        binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
        distinct = column.dictionary_encode()
        texts = distinct.dictionary
        if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_binary())  # a string may hold what is no UTF-8
        rows = [_row(parse, x.decode("utf-8", "surrogateescape") if isinstance(x, bytes) else x, to_row, binary) for x in texts.to_pylist()]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
        return pa.StructArray.from_arrays(columns, fields=list(arrow)).take(distinct.indices)

    return F.arrow_udf(run, schema)


def _row(parse, s, to_row, binary: bool):
    """A verdict's fields, those of a checked door included."""
    try:
        got = parse(s)
        value, adjusted, index = got if isinstance(got, _Judged) else (got, None, None)
        return to_row(value), True, None, None, None, None, None, adjusted, index, None
    except k.Fault as e:
        offset, length, detail = _span(s, e.offset, e.length, e.detail, binary)
        return None, False, e.reason, offset, length, detail, DETAILS[detail], None, None, None
    except Violation as e:
        offset, length, _ = _span(s, e.offset, e.length, None, binary)
        return to_row(e.value), False, None, offset, length, None, None, None, None, e.keyword


def _span(s, offset: int, length: int, detail: str | None, binary: bool):
    """In bytes for binary input, where a span of what is no UTF-8 says so."""
    if not binary:
        return offset, length, detail
    inside = s[offset : offset + length]
    if detail is not None and any("\ud800" <= c <= "\udfff" for c in inside):
        detail = "invalid_utf8"
    size = lambda t: len(t.encode("utf-8", "surrogateescape"))
    return size(s[:offset]), size(inside), detail


class _Judged(tuple):
    """(value, adjusted, enum index) of a checked door."""


def _judged(parse):
    return lambda s: _Judged(parse(s))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _native(value_type: str, checked: bool = False, *, value=None, ok: bool = False, reason=None, offset=None, length=None, detail=None, adjusted=None, keyword=None) -> Column:
    """A verdict of literals and columns."""
    code = F.lit(DETAILS[detail]) if detail else _none("int")
    put = lambda x, kind: _none(kind) if x is None else x.cast(kind) if isinstance(x, Column) else F.lit(x).cast(kind)
    fields = [(put(value, value_type), "value"), (F.lit(ok), "ok"), (put(reason, "string"), "reason"), (put(offset, "int"), "offset"), (put(length, "int"), "length"), (put(detail, "string"), "detail"), (code, "detail_code")]
    if checked:
        fields += [(put(adjusted, "boolean"), "adjusted"), (_none("int"), "enum_index"), (put(keyword, "string"), "keyword")]
    return F.struct(*[c.alias(n) for c, n in fields])


def _verdict(col: Column, lane, parse, value_type: str, to_row=_plain_value, raw: bool = False) -> Column:
    """lane: from the trimmed text to lane N's value, null where the kernel has to look; or None.

    raw: white space is no blank, only the empty text is.
    """
    lane_k = _kernel(parse, value_type, to_row)
    if lane is None:
        return lane_k(col)
    empty = _native(value_type, reason="empty", offset=0, length=0, detail="blank")
    pieces = lambda t: F.struct(lane(t).alias("value"), (F.length(col) == 0 if raw else t == "").alias("blank"))
    chosen = lambda x: F.when(x["value"].isNotNull(), _native(value_type, value=x["value"], ok=True)).when(x["blank"], empty)
    native = lanes.let(lanes.let(lanes.trimmed(col), pieces), chosen)
    return F.coalesce(native, lane_k(F.when(native.isNull(), col)))


# --- text doors --------------------------------------------------------------------


def _text_door(col: Column, door: Door, fmt: NumFormat, options: DateOptions, order: DateOrder, periods: DayPeriods, precision: UnixPrecision, epoch: ExcelEpoch):
    """(parse, a function from trimmed text to lane N's value, or None) of a door."""
    order, precision, epoch = DateOrder(order), UnixPrecision(precision), ExcelEpoch(epoch)
    if door.is_integer:
        return partial(k.cast_int, door=door, fmt=fmt), lambda t: lanes.integer(t, door, fmt)
    text = col.cast("string")
    return {
        Door.BOOL: (k.cast_bool, lambda t: lanes.boolean(t)),
        Door.CHAR: (k.cast_char, lambda t: lanes.character(text, t)),
        Door.F32: (partial(k.cast_float, door=door, fmt=fmt), lambda t: lanes.real(t, door, fmt)),
        Door.F64: (partial(k.cast_float, door=door, fmt=fmt), lambda t: lanes.real(t, door, fmt)),
        Door.DECIMAL: (partial(k.cast_decimal, fmt=fmt), lambda t: lanes.decimal(t, fmt)),
        Door.UUID: (k.cast_uuid, lambda t: lanes.uuid(t)),
        Door.TIMESTAMP: (partial(k.cast_timestamp, options=options), lambda t: lanes.timestamp(t, options)),
        Door.UNIX: (partial(k.cast_unix, precision=precision), lambda t: lanes.unix(t, precision)),
        Door.DATE: (partial(k.cast_date, options=options), lambda t: lanes.date(t, options)),
        Door.TIME: (k.cast_time, lambda t: lanes.time(t)),
        Door.DURATION: (k.cast_duration, lambda t: lanes.duration(t)),
        Door.TEXT: (k.cast_text, lambda t: F.when(F.is_valid_utf8(text) & (F.length(col) > 0), text)),
        Door.DATE_ORDERED: (partial(k.cast_date_ordered, order=order, options=options), lambda t: lanes.date_ordered(t, order, options)),
        Door.DATETIME: (partial(k.cast_datetime, order=order, periods=periods, options=options), lambda t: lanes.datetime(t, order, periods, options)),
        Door.EXCEL_SERIAL: (partial(k.cast_excel_serial, epoch=epoch), lambda t: lanes.excel_serial(t, epoch)),
    }[door]


def cast_door(col, door: Door, fmt: NumFormat = INVARIANT, *, options: DateOptions = DateOptions(), order: DateOrder = DateOrder.YMD, periods: DayPeriods = DayPeriods(), precision: UnixPrecision = UnixPrecision.SECONDS, epoch: ExcelEpoch = ExcelEpoch.E1900, native: bool = True) -> Column:
    """Any door by its code. native=False sends every row to the kernel."""
    col, door = _col(col), Door(door)
    parse, lane = _text_door(col, door, fmt, options, order, periods, precision, epoch)
    if not native or lane(F.lit("")) is None:
        lane = None
    # white space alone is empty but at two doors: one such character is a character, and text is taken as it is
    return _verdict(col, lane, parse, VALUE_TYPES[door], _TO_ROW.get(door, _plain_value), door in (Door.CHAR, Door.TEXT))


def _named(door: Door, takes_format: bool = False):
    if takes_format:
        def f(col, fmt: NumFormat = INVARIANT, **how) -> Column:
            return cast_door(col, door, fmt, **how)
    else:
        def f(col, **how) -> Column:
            return cast_door(col, door, **how)
    f.__name__ = f"cast_{door.name.lower()}"
    f.__doc__ = f"Verdict of the {door.name.lower()} door."
    return f


cast_bool, cast_char, cast_uuid, cast_timestamp, cast_date, cast_time, cast_duration, cast_text = (_named(d) for d in (Door.BOOL, Door.CHAR, Door.UUID, Door.TIMESTAMP, Door.DATE, Door.TIME, Door.DURATION, Door.TEXT))
cast_i8, cast_i16, cast_i32, cast_i64, cast_u8, cast_u16, cast_u32, cast_u64, cast_f32, cast_f64, cast_decimal = (_named(Door(d), True) for d in range(Door.I8, Door.DECIMAL + 1))


def cast_unix(col, precision: UnixPrecision, **how) -> Column:
    return cast_door(col, Door.UNIX, precision=precision, **how)


def cast_date_ordered(col, order: DateOrder, options: DateOptions = DateOptions(), **how) -> Column:
    return cast_door(col, Door.DATE_ORDERED, order=order, options=options, **how)


def cast_datetime(col, order: DateOrder, periods: DayPeriods = DayPeriods(), options: DateOptions = DateOptions(), **how) -> Column:
    return cast_door(col, Door.DATETIME, order=order, periods=periods, options=options, **how)


def cast_excel_serial(col, epoch: ExcelEpoch = ExcelEpoch.E1900, **how) -> Column:
    return cast_door(col, Door.EXCEL_SERIAL, epoch=epoch, **how)


# --- typed doors: doubles in ----------------------------------------------------------


def _typed(col, value_type: str, value, faults, parse, to_row=_plain_value) -> Column:
    """Verdict of a double: the first of faults (where, reason, detail) that holds, lane N's value, or the kernel's."""
    x = _col(col).cast("double")
    found = F.when(x.isNull(), _none(_schema(value_type)))
    for where, reason, detail in faults(x):
        found = found.when(where, _native(value_type, reason=reason, offset=0, length=0, detail=detail))
    found = found.otherwise(lanes.let(value(x), lambda v: F.when(v.isNotNull(), _native(value_type, value=v, ok=True))))
    return F.coalesce(found, _kernel(parse, value_type, to_row)(F.when(found.isNull(), x)))


def _not_finite(x: Column, infinite: str = "malformed"):
    return [(F.isnan(x), "malformed", "not_finite"), (F.abs(x) == lanes.INFINITE, infinite, "not_finite")]


_EXACT = 2.0**53


def from_f64(col, door: Door, *, precision: UnixPrecision = UnixPrecision.SECONDS, epoch: ExcelEpoch = ExcelEpoch.E1900) -> Column:
    """A decoded double through a numeric, bool, unix or spreadsheet door; its spans are empty."""
    door, kind = Door(door), VALUE_TYPES[Door(door)]
    # from 2**53 on a whole double has more digits than those that tell it apart; the kernel reads those
    whole = lambda x: F.when((F.abs(x) < _EXACT) & (x == F.rint(x)), x).cast("bigint")
    if door.is_integer:
        low, high, _ = INT_RANGES[door]

        def faults(x):
            small = F.abs(x) < _EXACT
            return [*_not_finite(x), (x != F.rint(x), "malformed", "not_whole"), (small & (x > float(high)), "out_of_range", "too_large"), (small & (x < float(low)), "out_of_range", "too_small" if low else "negative_not_allowed")]

        return _typed(col, kind, whole, faults, partial(k.int_from_f64, door=door), _TO_ROW.get(door, _plain_value))
    if door == Door.F32:
        return _typed(col, kind, lambda x: x.cast("float") + F.lit(0.0).cast("float"), lambda x: [*_not_finite(x, "out_of_range"), (F.abs(x.cast("float")) == lanes.INFINITE, "out_of_range", "too_large")], k.f32_from_f64)
    if door == Door.BOOL:
        return _typed(col, kind, lambda x: x == 1.0, lambda x: [*_not_finite(x), (~x.isin(0.0, 1.0), "malformed", "not_recognized")], k.bool_from_f64)
    if door == Door.DECIMAL:
        return _typed(col, kind, lambda x: lanes.decimal_value(lanes.few_places(x)), lambda x: _not_finite(x, "out_of_range"), k.decimal_from_f64, _TO_ROW[door])
    if door == Door.UNIX:
        per = UnixPrecision(precision).per_second
        return _typed(col, kind, lambda x: lanes.unix_value(whole(x), per), lambda x: [*_not_finite(x), (x != F.rint(x), "malformed", "not_whole")], partial(k.unix_from_f64, precision=UnixPrecision(precision)), _TO_ROW[door])
    if door != Door.EXCEL_SERIAL:
        raise ValueError(f"no typed door {door.name}")

    def serial(x):
        seconds = lanes.whole_seconds(x)
        rest = F.pmod(seconds, F.lit(86400).cast("bigint"))
        day = lanes.serial_days(F.call_function("div", seconds - rest, F.lit(86400).cast("bigint")), epoch)
        return F.when(day.isNotNull(), F.struct((day * 86400 + rest).alias("seconds"), F.lit(0).alias("nanos")))

    return _typed(col, kind, serial, _serial_faults, partial(k.excel_serial_from_f64, epoch=ExcelEpoch(epoch)), _TO_ROW[door])


def _serial_faults(x: Column):
    return [*_not_finite(x), (x < 0, "malformed", "negative_not_allowed"), (x >= float(k.LAST_SERIAL + 1), "out_of_range", "outside_window")]


def decimal_from_f64(col) -> Column:
    return from_f64(col, Door.DECIMAL)


def excel_serial(col, epoch: ExcelEpoch = ExcelEpoch.E1900) -> Column:
    return from_f64(col, Door.EXCEL_SERIAL, epoch=epoch)


def excel_time(col) -> Column:
    return _typed(col, "bigint", lambda x: F.pmod(lanes.whole_seconds(x), F.lit(86400).cast("bigint")) * lanes.SECOND, _serial_faults, k.excel_time)


def excel_duration(col) -> Column:
    def value(x):
        seconds = lanes.whole_seconds(x)
        return F.when(seconds.isNotNull(), F.struct(seconds.alias("seconds"), F.lit(0).alias("nanos")))

    return _typed(col, _INSTANT, value, lambda x: [*_not_finite(x), (F.abs(x * 86400.0) > float(k.MAX_SPAN), "out_of_range", "outside_window")], k.excel_duration, _fields("seconds", "nanos"))


def shortest_digits(col) -> Column:
    """The fewest digits that read back as the double, as text."""
    @F.arrow_udf("string")
    def digits(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else repr(v) for v in x.to_pylist()], pa.string())

    return digits(_col(col).cast("double"))


def assume_utc(civil: Column) -> Column:
    """A civil date and time of day as an instant, read in UTC."""
    nanos = civil["nanos_of_day"]
    return F.struct((F.unix_date(civil["date"]).cast("long") * 86400 + F.floor(nanos / 1_000_000_000)).alias("seconds"), F.pmod(nanos, F.lit(1_000_000_000)).cast("int").alias("nanos"))


def utc_civil(instant: Column) -> Column:
    """An instant's civil date and time of day in UTC."""
    days = F.floor(instant["seconds"] / 86400)
    return F.struct(F.date_from_unix_date(days.cast("int")).alias("date"), (F.pmod(instant["seconds"], F.lit(86400)) * 1_000_000_000 + instant["nanos"]).alias("nanos_of_day"))


# --- checked doors --------------------------------------------------------------------


_KEYWORDS = (("minimum", "minimum", lambda v, m: v < m), ("exclusive_minimum", "exclusiveMinimum", lambda v, m: v <= m), ("maximum", "maximum", lambda v, m: v > m), ("exclusive_maximum", "exclusiveMaximum", lambda v, m: v >= m))
#: Declared numbers that lane N compares: so many digits on either side of the point fit beside any value it reads.
_WIDE, _PLACES = 18, 6


def _simple(x: Decimal | None) -> bool:
    return x is None or abs(x) < 10**_WIDE and x == round(x, _PLACES)


def _native_checked(col: Column, t: Column, door: Door, c: Constraints, fmt: NumFormat):
    """A struct of a trimmed text and a function from it to the checked verdict, null where lane N doesn't read the text;
    None where the keywords need the kernel."""
    declared = [getattr(c, name) for name, _, _ in _KEYWORDS] + [c.multiple_of, *(c.enum or ())]
    if not all(map(_simple, declared)) or c.multiple_of is not None and (c.rounding != Rounding.STRICT or door == Door.DECIMAL):
        return None
    kind, wide = VALUE_TYPES[door], f"decimal({_WIDE + _PLACES},{_PLACES})"
    text = lanes.numeral(t, fmt, _PLACES if door == Door.DECIMAL else 0)
    if text is None:
        return None
    number = lambda x: F.lit(x).cast(wide)

    def judged(x: Column) -> Column:
        v, t = x["v"], x["t"]
        value = lanes.decimal_value(v) if door == Door.DECIMAL else v.cast(kind)
        broken = []
        if c.multiple_of is not None:
            broken.append(("multipleOf", v % number(c.multiple_of) != 0))
        broken += [(keyword, wrong(v, number(getattr(c, name)))) for name, keyword, wrong in _KEYWORDS if getattr(c, name) is not None]
        if c.enum is not None:
            broken.append(("enum", ~v.isin(*[number(x) for x in c.enum])))
        # the span is the whole text, where nothing had to be trimmed
        out = F.when(v.isNull() | (F.length(col) != F.length(t)), F.when(t == "", _native(kind, True, reason="empty", offset=0, length=0, detail="blank")))
        for keyword, wrong in broken:
            out = out.when(wrong, _native(kind, True, value=value, offset=0, length=F.length(t), keyword=keyword))
        return out.otherwise(_native(kind, True, value=value, ok=True, adjusted=False))

    v = text.try_cast(wide)
    if door.is_integer:
        low, high, _ = INT_RANGES[door]
        v = lanes.let(v, lambda v: F.when(v.between(*[F.lit(Decimal(max(min(x, 10**18 - 1), 1 - 10**18))).cast(wide) for x in (low, high)]), v))
    return F.struct(v.alias("v"), t.alias("t")), judged


def cast_checked(col, door: Door, constraints: Constraints, fmt: NumFormat = INVARIANT, *, native: bool = True, **how) -> Column:
    """A numeric door or the text door with keywords; the other doors, with none, take cast_door's arguments."""
    col, door = _col(col), Door(door)
    c, kind, to_row = constraints.check(door), VALUE_TYPES[door], _TO_ROW.get(door, _plain_value)
    if not door.is_numeric and door != Door.TEXT:
        plain = dict(options=DateOptions(), order=DateOrder.YMD, periods=DayPeriods(), precision=UnixPrecision.SECONDS, epoch=ExcelEpoch.E1900)
        if set(how) - set(plain):
            raise ValueError(f"unknown arguments: {sorted(set(how) - set(plain))}")
        parse, _ = _text_door(col, door, fmt, **plain | how)
        return _kernel(lambda s: _Judged((parse(s), False, None)), kind, to_row, True)(col)
    if how:
        raise ValueError(f"unknown arguments: {sorted(how)}")
    lane_k = _kernel(_judged(partial(_checked, door=door, c=c, fmt=fmt)), kind, to_row, True)
    if native and (door.is_integer or door == Door.DECIMAL) and _native_checked(col, F.lit(""), door, c, fmt) is not None:
        judged = _native_checked(col, F.lit(""), door, c, fmt)[1]
        found = lanes.let(lanes.let(lanes.trimmed(col), lambda t: _native_checked(col, t, door, c, fmt)[0]), judged)
        return F.coalesce(found, lane_k(F.when(found.isNull(), col)))
    return lane_k(col)


def checked_from_f64(col, door: Door, constraints: Constraints) -> Column:
    door = Door(door)
    if not door.is_numeric:
        raise ValueError(f"no checked typed door {door.name}")
    parse = _judged(partial(_checked_f64, door=door, c=constraints.check(door)))
    return _kernel(parse, VALUE_TYPES[door], _TO_ROW.get(door, _plain_value), True)(_col(col).cast("double"))


def cast_text_checked(col, constraints: Constraints) -> Column:
    return cast_checked(col, Door.TEXT, constraints)


# --- as Spark's own types ----------------------------------------------------------------


def as_timestamp(instant) -> Column:
    """An instant as TimestampType, cut to microseconds."""
    v = _col(instant)
    return F.timestamp_micros(v["seconds"] * 1_000_000 + F.call_function("div", v["nanos"].cast("bigint"), F.lit(1000).cast("bigint")))


def as_timestamp_ntz(civil) -> Column:
    """A civil date and time of day, or a serial's civil instant, as TimestampNTZType, cut to microseconds."""
    v = _col(civil)
    return F.to_timestamp_ntz(v["date"].cast("string")) + as_interval(F.struct(F.call_function("div", v["nanos_of_day"], F.lit(lanes.SECOND).cast("bigint")).alias("seconds"), F.pmod(v["nanos_of_day"], F.lit(lanes.SECOND).cast("bigint")).cast("int").alias("nanos")))


def as_interval(duration) -> Column:
    """A duration as DayTimeIntervalType, cut to microseconds towards zero."""
    v = _col(duration)
    seconds = v["seconds"].cast("decimal(18,6)") + F.call_function("div", v["nanos"].cast("bigint"), F.lit(1000).cast("bigint")).cast("decimal(18,6)") / 1000000
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


# --- by type --------------------------------------------------------------------------

_BY_TYPE = {T.BooleanType: Door.BOOL, T.ByteType: Door.I8, T.ShortType: Door.I16, T.IntegerType: Door.I32, T.LongType: Door.I64, T.FloatType: Door.F32, T.DoubleType: Door.F64, T.DateType: Door.DATE, T.TimestampType: Door.TIMESTAMP, T.StringType: Door.TEXT, T.DecimalType: Door.DECIMAL}


def cast_as(col, kind: T.DataType, fmt: NumFormat = INVARIANT, **how) -> Column:
    """The door of a Spark type."""
    return cast_door(col, _BY_TYPE[type(kind)], fmt, **how)
