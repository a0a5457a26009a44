"""Lane N: regular shapes of each door as native expressions.

Each function gives the value of a trimmed text, or null where the shape isn't regular and the kernel has to look. A
shape is taken only where the exact kernel would give the same value; faults are never decided here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import kernel as k
from ..codes import INT_RANGES, WHITE_SPACE, DateFlags, DateOrder, Door, ExcelEpoch, Flags, Grouping, UnixPrecision
from ..declarations import SPACES, DateOptions, DayPeriods, NumFormat

SECOND = 1_000_000_000
#: Fraction digits of a decimal that lane N reads: with up to six, no decimal is written with an exponent.
FRACTION = 6


def trimmed(col: Column) -> Column:
    return F.btrim(col.cast("string"), F.lit(WHITE_SPACE))


def let(value: Column, body) -> Column:
    """body of value, computed once: a lambda's variable isn't replaced by its expression, as a column would be.

    body must not use the variable of another let: a Python function's argument can't hold such a lambda.
    """
    return F.transform(F.array(value), body)[0]


def _long(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def instant(seconds: Column, nanos: Column) -> Column:
    """Null where the seconds are, or are outside the window."""
    return F.when(seconds.between(k.MIN_SECONDS, k.MAX_SECONDS), F.struct(seconds.cast("bigint").alias("seconds"), nanos.cast("int").alias("nanos")))


def numeral(t: Column, fmt: NumFormat, places: int) -> Column | None:
    """The numeral of so many fraction digits as plain text, or null; None where the declaration leaves no regular shape."""
    symbol = fmt.currency if fmt.has(Flags.CURRENCY) else ""
    point, group = fmt.decimal_sep, fmt.group_sep if fmt.has(Flags.GROUPING) else ""
    odd = set("0123456789+-()%eE") | set(SPACES)
    if fmt.has(Flags.SEPARATOR_DETECT) or len(point) != 1 or point in odd or len(group) > 1 or group in odd - set(SPACES):
        return None
    if set(symbol) & (odd | {point, group}) or fmt.currency_decimal_sep or fmt.currency_group_sep:
        symbol = ""
    groups = SPACES if group and group in SPACES else group
    whole = "[0-9]{1,18}"
    if groups:
        apart = f"[{re.escape(groups)}]"
        whole += f"|[1-9][0-9]?(?:{apart}[0-9]{{2}}){{0,6}}{apart}[0-9]{{3}}" if fmt.grouping == Grouping.INDIAN else f"|[1-9][0-9]{{0,2}}(?:{apart}[0-9]{{3}}){{1,5}}"
    body = f"(?:{whole})"
    if places:
        body = f"(?:{body}(?:{re.escape(point)}[0-9]{{0,{places}}})?|{re.escape(point)}[0-9]{{1,{places}}})"
    if symbol:
        body = f"(?:{re.escape(symbol)})?{body}"
    shape = f"[+-]?{body}" + (f"|\\({body}\\)" if fmt.has(Flags.PARENS) else "")
    # "(" reads as a minus, the rest that isn't of the number goes
    return F.when(t.rlike(f"\\A(?:{shape})\\z"), F.translate(t, "(" + point + ")+" + "".join(sorted(set(symbol + groups))), "-."))


def integer(t: Column, door: Door, fmt: NumFormat) -> Column | None:
    low, high, _ = INT_RANGES[door]
    text = numeral(t, fmt, 0)
    if text is None:
        return None
    n = text.try_cast("bigint")
    return n if low <= -(10**18) and high >= 10**18 else let(n, lambda n: F.when(n.between(low, min(high, 10**18)), n))


def real(t: Column, door: Door, fmt: NumFormat) -> Column | None:
    places = 30
    text = numeral(t, fmt, places)
    if text is None:
        return None
    kind = "float" if door == Door.F32 else "double"
    plain = text.try_cast(kind)
    if fmt.has(Flags.PERCENT):
        # of a percent, only the sign itself is taken off; the exponent keeps the reading exact
        hundredth = let(F.rtrim(F.substring(t, F.lit(1), F.length(t) - 1)), lambda h: F.concat(numeral(h, fmt, places), F.lit("e-2")).try_cast(kind))
        plain = F.when(t.endswith("%"), hundredth).otherwise(plain)
    return plain + F.lit(0.0).cast(kind)


def decimal(t: Column, fmt: NumFormat) -> Column | None:
    text = numeral(t, fmt, FRACTION)
    return None if text is None else decimal_value(text.try_cast(f"decimal({18 + FRACTION},{FRACTION})"))


def decimal_value(d: Column) -> Column:
    """Canonical parts of a decimal with FRACTION places."""

    def parts(text: Column) -> Column:
        places = F.length(F.substring_index(text, ".", -1))
        return F.when(text.isNotNull(), F.struct(
            F.translate(text, "-.", "").cast("decimal(29,0)").alias("magnitude"),
            F.when(F.instr(text, ".") > 0, places).otherwise(0).cast("tinyint").alias("scale"),
            text.startswith("-").alias("negative"),
            text.alias("text"),
        ))

    return let(F.rtrim(F.rtrim(d.cast("string"), F.lit("0")), F.lit(".")), parts)


def boolean(t: Column) -> Column:
    # ASCII before it is lowered: other letters have ASCII ones as their lower case
    word = F.when(t.rlike("\\A[A-Za-z01]{1,9}\\z"), F.lower(t))
    return let(word, lambda w: F.when(w.isin(*k.TRUE), F.lit(True)).when(w.isin(*k.FALSE), F.lit(False)))


def character(raw: Column, t: Column) -> Column:
    one = F.struct(raw.alias("value"), F.ascii(raw).alias("code_point"))
    n = F.when(t.rlike("\\A&#[0-9]{1,5};\\z"), F.substring(t, F.lit(3), F.length(t) - 3)).try_cast("int")
    named = lambda n: F.when(n < 0xD800, F.struct(F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE").alias("value"), n.alias("code_point")))
    return F.when((F.length(raw) == 1) & F.is_valid_utf8(raw), one).otherwise(let(n, named))


def uuid(t: Column) -> Column:
    digits = "[0-9a-fA-F]"
    dashed = f"{digits}{{8}}(?:-{digits}{{4}}){{3}}-{digits}{{12}}"
    shape = f"\\A(?:(?:[uU][rR][nN]:)?[uU][uU][iI][dD]:|[gG][uU][iI][dD]:)?(?:{dashed}|\\{{{dashed}\\}}|\\({dashed}\\)|{digits}{{32}})\\z"

    def written(h: Column) -> Column:
        parts = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(*[x for p in parts for x in (F.lit("-"), p)][1:])

    return let(F.when(t.rlike(shape), F.right(F.translate(F.lower(t), "{}()-", ""), F.lit(32))), written)


def _iso(text: Column) -> Column:
    """A date of yyyy-MM-dd, null where there is no such day or no year."""
    return F.when(text >= "0001", text).try_cast("date")


def date(t: Column, options: DateOptions) -> Column:
    text = F.when(t.rlike("\\A[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"), t)
    if options.flags & DateFlags.COMPACT_DATE:
        text = F.when(t.rlike("\\A[0-9]{8}\\z"), F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2), F.lit("-"), F.substring(t, 7, 2))).otherwise(text)
    return let(text, _iso)


def _ordered(order: DateOrder, options: DateOptions):
    """The shape of a separated date of digits, and a function from a text of that shape to its date."""
    year = "(?:[0-9]{4}|[0-9]{2})" if options.pivot else "[0-9]{4}"
    if order == DateOrder.YMD:
        shape, places = f"{year}([/.-])[0-9]{{1,2}}\\1[0-9]{{1,2}}", (0, 1, 2)
    else:
        shape, places = f"[0-9]{{1,2}}([/.-])[0-9]{{1,2}}\\1{year}", (2, 0, 1) if order == DateOrder.MDY else (2, 1, 0)

    def full(y: Column) -> Column:
        if not options.pivot:
            return y
        return F.when(F.length(y) == 2, F.lpad((F.lit(options.pivot) - F.pmod(F.lit(options.pivot) - y.try_cast("int"), F.lit(100))).cast("string"), 4, "0")).otherwise(y)

    def read(t: Column) -> Column:
        def day(u: Column) -> Column:
            fields = (F.substring_index(u, "/", 1), F.substring_index(F.substring_index(u, "/", 2), "/", -1), F.substring_index(u, "/", -1))
            y, m, d = (fields[p] for p in places)
            return F.concat(full(y), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))

        return let(let(F.translate(t, ".-", "//"), day), _iso)

    return shape, read


def date_ordered(t: Column, order: DateOrder, options: DateOptions) -> Column:
    shape, read = _ordered(order, options)
    return F.when(t.rlike(f"\\A{shape}\\z"), read(t))


def _clock(t: Column) -> Column:
    """Seconds of H:mm or H:mm:ss; the text is short, so its fields are cut from its end."""
    two = lambda at: _long(F.substring(t, at, 2))
    long = F.length(t) > 5
    hour = _long(F.substring_index(t, ":", 1))
    return hour * 3600 + F.when(long, two(-5) * 60 + two(-2)).otherwise(two(-2) * 60)


def datetime(t: Column, order: DateOrder, periods: DayPeriods, options: DateOptions) -> Column:
    shape, read = _ordered(order, options)
    time = "(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?|(?:0?[1-9]|1[0-2]):[0-5][0-9](?::[0-5][0-9])? ?[AaPp][Mm]"
    if periods.am or periods.pm:
        time = time.split("|(?:0?", 1)[0]  # a declared word may begin like one of these

    def of_day(x: Column) -> Column:
        clock, rest = x["clock"], x["rest"]
        hour = _long(F.substring_index(clock, ":", 1))
        # the hour has one digit or two, so a leading zero makes the lengths alike
        total = _clock(F.lpad(clock, F.when(F.length(clock) > 5, 8).otherwise(5), F.lit("0")))
        return (total + F.when(rest.rlike("[Pp]") & (hour < 12), 43200).when(rest.rlike("[Aa]") & (hour == 12), -43200).otherwise(0)) * SECOND

    rest = F.when(t.rlike(" [AaPp][Mm]\\z"), F.substring_index(t, " ", -2)).otherwise(F.substring_index(t, " ", -1))
    clock = let(rest, lambda r: F.struct(F.rtrim(F.translate(r, "AaPpMm", "")).alias("clock"), r.alias("rest")))
    pieces = F.struct(read(F.substring_index(t, " ", 1)).alias("date"), let(clock, of_day).alias("nanos_of_day"))
    return let(F.when(t.rlike(f"\\A{shape} (?:{time})\\z"), pieces), lambda x: F.when(x["date"].isNotNull(), x))


def _nanos(digits: Column) -> Column:
    """Nanoseconds of a fraction's digits, cut after nine."""
    return _long(F.rpad(digits, 9, "0"))


def time(t: Column) -> Column:
    shape = "\\A(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.][0-9]+)?)?\\z"
    part = F.when(F.length(t) > 9, _nanos(F.substring(t, F.lit(10), F.length(t)))).otherwise(0)
    return F.when(t.rlike(shape), let(F.substring(t, 1, 8), _clock) * SECOND + part)


def timestamp(t: Column, options: DateOptions) -> Column:
    gap = "[Tt ]" if options.flags & DateFlags.SPACE_SEPARATOR else "[Tt]"
    minutes = "(?::[0-5][0-9])?" if options.flags & DateFlags.HOUR_OFFSET else ":[0-5][0-9]"
    shape = f"\\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{gap}(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:[.][0-9]+)?(?:[Zz]|[+-](?:[01][0-9]|2[0-3]){minutes})\\z"

    def zoned(rest: Column) -> Column:
        """Seconds and nanos that what follows the seconds adds."""
        offset = F.substring_index(F.translate(rest, "+", "-"), "-", -1)
        shift = _long(F.substring(offset, 1, 2)) * 3600 + _long(F.substring(offset, 4, 2)) * 60
        shift = F.when(F.instr(rest, "+") > 0, -shift).when(F.instr(rest, "-") > 0, shift).otherwise(0)
        part = F.when(rest.startswith("."), _nanos(F.substring_index(F.translate(F.substring(rest, F.lit(2), F.length(rest)), "+Zz", "---"), "-", 1))).otherwise(0)
        return F.struct(shift.alias("seconds"), part.alias("nanos"))

    def total(x: Column) -> Column:
        return F.struct((x["day"].cast("bigint") * 86400 + x["clock"] + x["more"]["seconds"]).alias("seconds"), x["more"]["nanos"].alias("nanos"))

    pieces = F.struct(F.unix_date(let(F.substring(t, 1, 10), _iso)).alias("day"), let(F.substring(t, 12, 8), _clock).alias("clock"), let(F.substring(t, F.lit(20), F.length(t)), zoned).alias("more"))
    return let(let(F.when(t.rlike(shape), pieces), total), lambda x: instant(x["seconds"], x["nanos"]))


def unix(t: Column, precision: UnixPrecision) -> Column:
    per = UnixPrecision(precision).per_second
    return let(F.when(t.rlike("\\A[+-]?[0-9]{1,18}\\z"), t).try_cast("bigint"), lambda n: unix_value(n, per))


def unix_value(n: Column, per: int) -> Column:
    rest = F.pmod(n, F.lit(per).cast("bigint"))
    pieces = F.struct((F.call_function("div", n - rest, F.lit(per).cast("bigint")) if per > 1 else n).alias("seconds"), (rest * (SECOND // per)).alias("nanos"))
    return let(pieces, lambda x: instant(x["seconds"], x["nanos"]))


def duration(t: Column) -> Column:
    iso = "\\AP(?=[0-9T])(?:[0-9]{1,6}D)?(?:T(?=[0-9])(?:[0-9]{1,6}H)?(?:[0-9]{1,6}M)?(?:[0-9]{1,9}S)?)?\\z"

    def iso_seconds(u: Column) -> Column:
        # units are in a fixed order, so the number before one follows the last mark before it
        unit = lambda mark, per: F.when(F.instr(u, mark) > 0, _long(F.substring_index(F.translate(F.substring_index(u, mark, 1), "PDTHM", "/////"), "/", -1)) * per).otherwise(0)
        return unit("D", 86400) + unit("H", 3600) + unit("M", 60) + unit("S", 1)

    seconds = F.when(t.startswith("P"), F.when(t.rlike(iso), iso_seconds(t))).when(
        F.instr(t, ":") > 0, F.when(t.rlike("\\A(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?\\z"), let(F.lpad(t, F.when(F.length(t) > 5, 8).otherwise(5), F.lit("0")), _clock))
    ).otherwise(F.when(t.rlike("\\A[0-9]{1,11}[sS]\\z"), F.substring(t, F.lit(1), F.length(t) - 1)).try_cast("bigint"))
    return let(seconds, lambda n: F.when(n <= k.MAX_SPAN, F.struct(n.alias("seconds"), F.lit(0).alias("nanos"))))


def serial_days(n: Column, epoch: ExcelEpoch) -> Column:
    """Days since 1970 of a serial's whole part; null where the epoch has no such day."""
    epoch = ExcelEpoch(epoch)
    first, last = (1, k.LAST_SERIAL) if epoch == ExcelEpoch.E1900 else (0, k.LAST_SERIAL - 1462)

    def day(n: Column) -> Column:
        at = n + (-25569 if epoch == ExcelEpoch.E1900 else -24107)
        if epoch == ExcelEpoch.E1900:
            at = F.when(n < 60, at + 1).when(n > 60, at)
        return F.when(n.between(first, last), at)

    return let(n, day)


def excel_serial(t: Column, epoch: ExcelEpoch) -> Column:
    part = F.when(F.instr(t, ".") > 0, F.rpad(F.substring_index(t, ".", -1), 14, "0")).otherwise(F.lit("0"))
    wide = lambda x: x.try_cast("decimal(15,0)")
    of_day = F.call_function("div", wide(part) * wide(F.lit(k.DAY_NANOS)), wide(F.lit(10**14)))
    pieces = F.struct(serial_days(F.substring_index(t, ".", 1).try_cast("bigint"), epoch).alias("day"), of_day.alias("nanos"))
    second = F.lit(SECOND).cast("bigint")
    value = lambda x: F.when(x["day"].isNotNull(), F.struct((x["day"] * 86400 + F.call_function("div", x["nanos"], second)).cast("bigint").alias("seconds"), F.pmod(x["nanos"], second).cast("int").alias("nanos")))
    return let(F.when(t.rlike("\\A[0-9]{1,7}(?:[.][0-9]+)?\\z"), pieces), value)


# --- numbers already decoded ----------------------------------------------------------

INFINITE = float("inf")


def whole_seconds(x: Column) -> Column:
    """The whole seconds that are stored as this count of days, or null; at most one is."""
    return let(F.rint(x * 86400.0), lambda s: F.when((s / 86400.0 == x) & (F.abs(x) < 2.0**22), s).cast("bigint"))


def few_places(x: Column) -> Column:
    """The decimal of at most FRACTION places and 15 digits that is stored as x, or null: no other is as short."""
    d = F.when(F.abs(x) < 1e9, x).try_cast(f"decimal({18 + FRACTION},{FRACTION})")
    return let(d, lambda d: F.when(d.cast("double") == x, d))
