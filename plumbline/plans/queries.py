"""Queries of the doors and the SQL that says what they must return.

The tables hold no messy text, so each query renders text from keys and dates by an expression that Spark and the
oracle's SQL both read, spoils a seventh of the rows and empties another, and casts. The oracle computes values from
the columns and faults from the rule of spoiling, never by parsing the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codes import DateFlags, DateOrder, Door, ExcelEpoch, Flags, Grouping, Rounding, UnixPrecision
from ..declarations import DETECT, INVARIANT, Constraints, DateOptions, DayPeriods, MonthNames
from ..functions import doors as d
from ..operators import verdicts as v
from . import sites

LINE = ("lineitem", "l_orderkey, l_linenumber", "(l_orderkey + l_linenumber)")
ORDER = ("orders", "o_orderkey", "o_orderkey")
CUSTOMER = ("customer", "c_custkey", "c_custkey")


@dataclass(frozen=True)
class Case:
    """One door over rendered text. value: of the verdict; expected: the same in SQL; spoiled: reason, detail, offset, length in SQL."""

    name: str
    source: tuple[str, str, str]
    text: str
    door: object
    expected: str
    value: object = staticmethod(lambda x: x["value"])
    spoil: str = "t || 'x'"
    spoiled: tuple[str, str, str, str] = ("'malformed'", "'unexpected_character'", "length(t)", "1")
    clean: bool = False

    def spark(self, spark, sf_dir) -> DataFrame:
        table, keys, key = self.source
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*keys.split(", "), f"{self.text} AS t", f"{key} AS k")
        if not self.clean:
            rows = rows.withColumn("t", F.expr(f"CASE WHEN k % 7 = 0 THEN {self.spoil} WHEN k % 7 = 1 THEN '  ' ELSE t END"))
        got = rows.withColumn("v", self.door(F.col("t")))
        return got.select(*keys.split(", "), self.value(F.col("v")).alias("value"), F.col("v.ok").alias("ok"), F.col("v.reason").alias("reason"), F.col("v.detail").alias("detail"), F.col("v.offset").cast("int").alias("offset"), F.col("v.length").cast("int").alias("length"))

    def sql(self) -> str:
        table, keys, key = self.source
        inner = f"SELECT *, {self.text} AS t, {key} AS k FROM {table}"
        if self.clean:
            return f"SELECT {keys}, {self.expected} AS value, true AS ok, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS INTEGER) AS \"offset\", CAST(NULL AS INTEGER) AS length FROM ({inner})"
        pick = lambda bad, empty, good: f"CASE k % 7 WHEN 0 THEN {bad} WHEN 1 THEN {empty} ELSE {good} END"
        r, x, o, n = self.spoiled
        return (
            f"SELECT {keys}, {pick('NULL', 'NULL', self.expected)} AS value, k % 7 > 1 AS ok, {pick(r, chr(39) + 'empty' + chr(39), 'NULL')} AS reason, "
            f"{pick(x, chr(39) + 'blank' + chr(39), 'NULL')} AS detail, CAST({pick(o, '0', 'NULL')} AS INTEGER) AS \"offset\", CAST({pick(n, '0', 'NULL')} AS INTEGER) AS length FROM ({inner})"
        )


_DAY = "month(l_shipdate) || '/' || day(l_shipdate) || '/' || year(l_shipdate)"
_ISO = "year(l_shipdate) || '-' || lpad(CAST(month(l_shipdate) AS STRING), 2, '0') || '-' || lpad(CAST(day(l_shipdate) AS STRING), 2, '0')"
_DATE = "CAST(l_shipdate AS DATE)"
#: Thousands with one separator: the head is below 1000 for the keys taken.
_GROUPED = "CAST(100 + l_orderkey % 900 AS STRING) || ',' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0')"
_GROUPED_VALUE = "((100 + l_orderkey % 900) * 1000 + l_partkey % 1000)"
_CENTS = "lpad(CAST(l_suppkey % 100 AS STRING), 2, '0')"
_EPOCH_DAYS = f"CAST({_DATE} - DATE '1970-01-01' AS BIGINT)"
_HMS = "lpad(CAST(l_orderkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(l_partkey % 60 AS STRING), 2, '0') || ':' || lpad(CAST(l_suppkey % 60 AS STRING), 2, '0')"
_HMS_SECONDS = "(l_orderkey % 24 * 3600 + l_partkey % 60 * 60 + l_suppkey % 60)"
_UUID = "lpad(CAST(l_orderkey % 100000000 AS STRING), 8, '0') || '-0000-4000-8000-' || lpad(CAST(l_partkey AS STRING), 12, '0')"
_MONTHS = tuple((n, w) for n, w in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1))
_MONTH_TEXT = "CASE month(l_shipdate) " + " ".join(f"WHEN {n} THEN '{w}'" for n, w in _MONTHS) + " END"
_DOLLAR = INVARIANT.with_currency("$")
_EURO = INVARIANT.with_separators(",", ".")
_TRAILING = ("'malformed'", "'trailing_text'", "length(t)", "1")
_WHOLE = "length(t) + 1"

CASES = [
    Case("door_bool", ORDER, "CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN 'T' ELSE '0' END", d.cast_bool, "o_orderkey % 4 IN (0, 2)", spoiled=("'malformed'", "'not_recognized'", "0", _WHOLE)),
    Case("door_char", ORDER, "'&#' || CAST(65 + o_orderkey % 26 AS STRING) || ';'", d.cast_char, "chr(CAST(65 + o_orderkey % 26 AS INTEGER))", lambda x: x["value"]["value"], "t || 'x'", ("'malformed'", "'trailing_text'", "length(t)", "1")),
    Case("door_i8", LINE, "CAST(l_linenumber * 9 AS STRING)", d.cast_i8, "CAST(l_linenumber * 9 AS TINYINT)", spoil="'1' || lpad(t, 3, '9')", spoiled=("'out_of_range'", "'too_large'", "0", "4")),
    Case("door_i16", LINE, "'-' || CAST(l_partkey % 30000 AS STRING)", d.cast_i16, "CAST(-(l_partkey % 30000) AS SMALLINT)"),
    Case("door_i32_grouped", LINE, _GROUPED, d.cast_i32, f"CAST({_GROUPED_VALUE} AS INTEGER)"),
    Case("door_i64_indian", LINE, "CAST(10 + l_orderkey % 90 AS STRING) || ',' || lpad(CAST(l_suppkey % 100 AS STRING), 2, '0') || ',' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0')", lambda c: d.cast_i64(c, INVARIANT.with_grouping(Grouping.INDIAN)), "CAST((10 + l_orderkey % 90) * 100000 + l_suppkey % 100 * 1000 + l_partkey % 1000 AS BIGINT)"),
    Case("door_u8", LINE, "CAST(l_linenumber AS STRING)", d.cast_u8, "CAST(l_linenumber AS SMALLINT)", spoil="'-' || t", spoiled=("'out_of_range'", "'negative_not_allowed'", "0", _WHOLE)),
    Case("door_u16_radix", LINE, "'0b' || CAST(l_orderkey % 2 AS STRING) || '01'", d.cast_u16, "CAST(l_orderkey % 2 * 4 + 1 AS INTEGER)", spoiled=("'malformed'", "'digit_expected'", "length(t)", "1")),
    Case("door_u32_exponent", LINE, "CAST(1 + l_linenumber AS STRING) || 'e3'", d.cast_u32, "CAST((1 + l_linenumber) * 1000 AS BIGINT)"),
    Case("door_u64_parens", LINE, "'(0)'", d.cast_u64, "CAST(0 AS DECIMAL(20, 0))", spoil="'(5)'", spoiled=("'out_of_range'", "'negative_not_allowed'", "0", "3")),
    Case("door_f32", LINE, "CAST(l_linenumber AS STRING) || '.5'", d.cast_f32, "CAST(l_linenumber + 0.5 AS DOUBLE)", lambda x: x["value"].cast("double")),
    Case("door_f64_percent", LINE, "CAST(l_linenumber * 25 AS STRING) || '%'", d.cast_f64, "CAST(l_linenumber AS DOUBLE) / 4", spoil="t || '%'", spoiled=("'malformed'", "'unexpected_character'", "length(t) - 1", "1")),
    Case("door_f64_eurozone", LINE, "CAST(1 + l_orderkey % 9 AS STRING) || '.' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') || ',25'", lambda c: d.cast_f64(c, _EURO), "CAST((1 + l_orderkey % 9) * 1000 + l_partkey % 1000 AS DOUBLE) + 0.25"),
    Case("door_decimal_currency", LINE, f"'$' || {_GROUPED} || '.' || {_CENTS} || '1'", lambda c: d.cast_decimal(c, _DOLLAR), f"CAST({_GROUPED_VALUE} AS STRING) || '.' || {_CENTS} || '1'", lambda x: x["value"]["text"]),
    Case("door_detect", LINE, "CAST(1 + l_orderkey % 9 AS STRING) || '.' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') || ',5'", lambda c: d.cast_decimal(c, DETECT), "CAST((1 + l_orderkey % 9) * 1000 + l_partkey % 1000 AS STRING) || '.5'", lambda x: x["value"]["text"], "'1,234'", ("'malformed'", "'ambiguous_separator'", "1", "1")),
    Case("door_uuid_forms", LINE, f"CASE l_linenumber % 3 WHEN 0 THEN {_UUID} WHEN 1 THEN '{{' || {_UUID} || '}}' ELSE 'urn:uuid:' || replace({_UUID}, '-', '') END", d.cast_uuid, _UUID, spoil="'12345'", spoiled=("'malformed'", "'wrong_length'", "0", "5")),
    Case("door_timestamp_offset", LINE, f"{_ISO} || 'T' || {_HMS} || '+01:00'", d.cast_timestamp, f"CAST({_EPOCH_DAYS} * 86400 + {_HMS_SECONDS} - 3600 AS BIGINT)", lambda x: x["value"]["seconds"], spoiled=_TRAILING),
    Case("door_unix_ms", LINE, "CAST(l_orderkey * 1000 + l_linenumber AS STRING)", lambda c: d.cast_unix(c, UnixPrecision.MILLIS), "CAST(l_orderkey AS BIGINT)", lambda x: x["value"]["seconds"]),
    Case("door_date_iso", LINE, _ISO, d.cast_date, _DATE, spoiled=("'malformed'", "'wrong_length'", "0", _WHOLE)),
    Case("door_date_compact", LINE, f"replace({_ISO}, '-', '')", lambda c: d.cast_date(c, options=DateOptions(DateFlags.COMPACT_DATE)), _DATE, spoiled=("'malformed'", "'wrong_length'", "0", _WHOLE)),
    Case("door_date_mdy", LINE, _DAY, lambda c: d.cast_date_ordered(c, DateOrder.MDY), _DATE, spoiled=_TRAILING),
    Case("door_date_months", LINE, f"day(l_shipdate) || '-' || {_MONTH_TEXT} || '-' || year(l_shipdate)", lambda c: d.cast_date_ordered(c, DateOrder.DMY, DateOptions(months=MonthNames(_MONTHS))), _DATE, spoiled=_TRAILING),
    Case("door_date_pivot", LINE, "month(l_shipdate) || '/' || day(l_shipdate) || '/' || lpad(CAST(year(l_shipdate) % 100 AS STRING), 2, '0')", lambda c: d.cast_date_ordered(c, DateOrder.MDY, DateOptions(pivot=2049)), _DATE, spoiled=_TRAILING),
    Case("door_datetime_ampm", LINE, f"{_DAY} || ' ' || CAST(1 + l_linenumber AS STRING) || ':05 pm'", lambda c: d.cast_datetime(c, DateOrder.MDY), "CAST((13 + l_linenumber) * 3600 + 300 AS BIGINT) * 1000000000", lambda x: x["value"]["nanos_of_day"], spoiled=_TRAILING),
    Case("door_time", LINE, _HMS, d.cast_time, f"CAST({_HMS_SECONDS} AS BIGINT) * 1000000000", spoiled=_TRAILING),
    Case("door_duration_iso", LINE, "'P' || CAST(l_linenumber AS STRING) || 'DT' || CAST(l_partkey % 24 AS STRING) || 'H30M'", d.cast_duration, "CAST(l_linenumber * 86400 + l_partkey % 24 * 3600 + 1800 AS BIGINT)", lambda x: x["value"]["seconds"], spoil="t || '5Y'", spoiled=("'malformed'", "'unknown_unit'", "length(t) + 1", "1")),
    Case("door_duration_clock", LINE, _HMS, d.cast_duration, f"CAST({_HMS_SECONDS} AS BIGINT)", lambda x: x["value"]["seconds"], spoiled=_TRAILING),
    Case("door_excel_1900", LINE, "CAST(25569 + l_orderkey % 20000 AS STRING) || '.5'", lambda c: d.cast_excel_serial(c, ExcelEpoch.E1900), "CAST(l_orderkey % 20000 * 86400 + 43200 AS BIGINT)", lambda x: x["value"]["seconds"]),
    Case("door_text", CUSTOMER, "c_name", d.cast_text, "c_name", clean=True),
]


def date_mdy_revenue(spark, sf_dir) -> DataFrame:
    """Revenue of the lines whose rendered ship date reads, and lines by reason."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"CASE WHEN l_orderkey % 7 = 0 THEN '13/45/' || year(l_shipdate) WHEN l_orderkey % 7 = 1 THEN '' ELSE {_DAY} END AS t", "CAST(l_extendedprice AS DECIMAL(18, 2)) AS price")
    got = rows.withColumn("v", d.cast_date_ordered("t", DateOrder.MDY))
    return got.groupBy(F.coalesce("v.reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("v.ok"), F.col("price"))).cast("decimal(28,2)").alias("revenue"))


_REVENUE_SQL = """
SELECT CASE l_orderkey % 7 WHEN 0 THEN 'out_of_range' WHEN 1 THEN 'empty' ELSE 'ok' END AS reason, count(*) AS n,
       CAST(sum(CASE WHEN l_orderkey % 7 > 1 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS DECIMAL(28, 2)) AS revenue
FROM lineitem GROUP BY ALL
"""


def _grouped_verdicts(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", f"CASE l_orderkey % 7 WHEN 0 THEN {_GROUPED} || 'x' WHEN 1 THEN '' ELSE {_GROUPED} END AS t")
    return rows.withColumn("v", d.cast_i32("t"))


def verdict_faults(spark, sf_dir):
    return v.faults(_grouped_verdicts(spark, sf_dir), "v", "l_orderkey", "l_linenumber")


def verdict_profile(spark, sf_dir):
    return v.fault_profile(_grouped_verdicts(spark, sf_dir), "v")


def verdict_summary(spark, sf_dir):
    return v.summary(_grouped_verdicts(spark, sf_dir), "v")


def verdict_optional(spark, sf_dir):
    rows = _grouped_verdicts(spark, sf_dir).withColumn("v", v.optional("v"))
    return v.summary(rows, "v")


def typed_decimal(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") / 4).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", d.decimal_from_f64("x")["value"]["text"].alias("value"))


def typed_excel_serial(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.lit(25569.0) + F.col("l_orderkey") % 20000 + F.col("l_linenumber") / 24).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", d.excel_serial("x")["value"]["seconds"].alias("value"))


def typed_excel_time(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") / 24).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", d.excel_time("x")["value"].alias("value"))


def typed_excel_duration(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (-F.col("l_linenumber") / 24).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", d.excel_duration("x")["value"]["seconds"].alias("value"))


def typed_unix(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderkey").cast("double").alias("x"))
    return rows.select("o_orderkey", d.from_f64("x", Door.UNIX, precision=UnixPrecision.SECONDS)["value"]["seconds"].alias("value"))


def typed_i32(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") / 2).alias("x"))
    t = d.from_f64("x", Door.I32)
    return rows.withColumn("v", t).select("l_orderkey", "l_linenumber", F.col("v.value").alias("value"), F.col("v.detail").alias("detail"))


def typed_f32(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") / 2).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", d.from_f64("x", Door.F32)["value"].cast("double").alias("value"))


def typed_bool(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 3).cast("double").alias("x"))
    return rows.withColumn("v", d.from_f64("x", Door.BOOL)).select("o_orderkey", F.col("v.value").alias("value"), F.col("v.reason").alias("reason"))


def checked_multiple_of(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "CAST(l_partkey AS STRING) AS t")
    c = d.cast_checked("t", Door.I64, Constraints(multiple_of=5, rounding=Rounding.FLOOR))
    return rows.withColumn("v", c).select("l_orderkey", "l_linenumber", F.col("v.value").alias("value"), F.col("v.adjusted").alias("adjusted"))


def checked_bounds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "CAST(l_linenumber AS STRING) || '.5' AS t")
    c = d.cast_checked("t", Door.DECIMAL, Constraints(minimum="2.5", exclusive_maximum="5.5"))
    return rows.withColumn("v", c).select("l_orderkey", "l_linenumber", F.col("v.value.text").alias("value"), F.col("v.keyword").alias("keyword"))


def checked_from_f64(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") / 2).alias("x"))
    c = d.checked_from_f64("x", Door.F64, Constraints(multiple_of=1, rounding=Rounding.CEILING, maximum=3))
    return rows.withColumn("v", c).select("l_orderkey", "l_linenumber", F.col("v.value").alias("value"), F.col("v.keyword").alias("keyword"))


def checked_text_enum(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "'  ' || lower(c_mktsegment) || ' ' AS t")
    c = d.cast_text_checked("t", Constraints(trim=True, max_length=9, enum=("BUILDING", "MACHINERY", "FURNITURE")))
    return rows.withColumn("v", c).select("c_custkey", F.col("v.value").alias("value"), F.col("v.keyword").alias("keyword"), F.col("v.enum_index").alias("enum_index"))


def checked_enum(spark, sf_dir):
    """Numbers of an enum have no index; a value outside it comes along."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "' ' || CAST(l_linenumber AS STRING) AS t")
    c = d.cast_checked("t", Door.U8, Constraints(enum=(1, "2.0", 7)))
    return rows.withColumn("v", c).select("l_orderkey", "l_linenumber", F.col("v.value").alias("value"), F.col("v.keyword").alias("keyword"), F.col("v.offset").alias("offset"), F.col("v.enum_index").alias("enum_index"))


def checked_wide_bound(spark, sf_dir):
    """A bound of 29 digits, the most that a declared number has."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "'7922816251426433759354395033' || CAST(l_linenumber + 2 AS STRING) AS t")
    c = d.cast_checked("t", Door.DECIMAL, Constraints(maximum="79228162514264337593543950334"))
    return rows.withColumn("v", c).select("l_orderkey", "l_linenumber", F.col("v.value.text").alias("value"), F.col("v.keyword").alias("keyword"), F.col("v.reason").alias("reason"), F.col("v.detail").alias("detail"))


def as_spark_types(spark, sf_dir):
    """Instants and durations as Spark's own types, rendered by their fields."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", f"{_ISO} || 'T' || {_HMS} || '.5Z' AS t", f"{_HMS} AS s")
    got = rows.select("l_orderkey", "l_linenumber", d.as_timestamp(d.cast_timestamp("t")["value"]).alias("ts"), d.as_interval(d.cast_duration("s")["value"]).alias("span"))
    return got.select("l_orderkey", "l_linenumber", F.unix_micros("ts").alias("micros"), F.expr("CAST(extract(HOUR FROM span) * 3600 + extract(MINUTE FROM span) * 60 + extract(SECOND FROM span) AS BIGINT)").alias("seconds"))


_LINES = "SELECT l_orderkey, l_linenumber, {} FROM lineitem"
_MK = "c_mktsegment"

OTHERS = {
    "door_date_mdy_revenue": (date_mdy_revenue, _REVENUE_SQL),
    "verdict_faults": (verdict_faults, f"SELECT l_orderkey, l_linenumber, CASE l_orderkey % 7 WHEN 0 THEN 'malformed' ELSE 'empty' END AS reason, CAST(CASE l_orderkey % 7 WHEN 0 THEN length({_GROUPED}) ELSE 0 END AS INTEGER) AS \"offset\", CAST(1 - l_orderkey % 7 AS INTEGER) AS length, CASE l_orderkey % 7 WHEN 0 THEN 'unexpected_character' ELSE 'blank' END AS detail FROM lineitem WHERE l_orderkey % 7 < 2"),
    "verdict_profile": (verdict_profile, "SELECT CASE l_orderkey % 7 WHEN 0 THEN 'malformed' WHEN 1 THEN 'empty' END AS reason, CASE l_orderkey % 7 WHEN 0 THEN 'unexpected_character' WHEN 1 THEN 'blank' END AS detail, count(*) AS n FROM lineitem GROUP BY ALL"),
    "verdict_summary": (verdict_summary, "SELECT count(*) FILTER (l_orderkey % 7 > 1) AS n_ok, count(*) FILTER (l_orderkey % 7 <= 1) AS n_faulted, CAST(0 AS BIGINT) AS n_missing FROM lineitem"),
    "verdict_optional": (verdict_optional, "SELECT count(*) FILTER (l_orderkey % 7 > 1) AS n_ok, count(*) FILTER (l_orderkey % 7 = 0) AS n_faulted, count(*) FILTER (l_orderkey % 7 = 1) AS n_missing FROM lineitem"),
    "typed_decimal": (typed_decimal, _LINES.format("CAST(l_linenumber // 4 AS STRING) || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS value")),
    "typed_excel_serial": (typed_excel_serial, _LINES.format("CAST(l_orderkey % 20000 * 86400 + l_linenumber * 3600 AS BIGINT) AS value")),
    "typed_excel_time": (typed_excel_time, _LINES.format("CAST(l_linenumber AS BIGINT) * 3600000000000 AS value")),
    "typed_excel_duration": (typed_excel_duration, _LINES.format("CAST(l_linenumber AS BIGINT) * -3600 AS value")),
    "typed_unix": (typed_unix, "SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS value FROM orders"),
    "typed_i32": (typed_i32, _LINES.format("CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber // 2 AS INTEGER) END AS value, CASE WHEN l_linenumber % 2 = 1 THEN 'not_whole' END AS detail")),
    "typed_f32": (typed_f32, _LINES.format("CAST(l_linenumber AS DOUBLE) / 2 AS value")),
    "typed_bool": (typed_bool, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS value, CASE o_orderkey % 3 WHEN 2 THEN 'malformed' END AS reason FROM orders"),
    "checked_multiple_of": (checked_multiple_of, _LINES.format("CAST(l_partkey - l_partkey % 5 AS BIGINT) AS value, l_partkey % 5 > 0 AS adjusted")),
    "checked_bounds": (checked_bounds, _LINES.format("CAST(l_linenumber AS STRING) || '.5' AS value, CASE WHEN l_linenumber < 2 THEN 'minimum' WHEN l_linenumber >= 5 THEN 'exclusiveMaximum' END AS keyword")),
    "checked_from_f64": (checked_from_f64, _LINES.format("CASE WHEN l_linenumber > 6 THEN CAST(l_linenumber AS DOUBLE) / 2 ELSE ceil(CAST(l_linenumber AS DOUBLE) / 2) END AS value, CASE WHEN l_linenumber > 6 THEN 'maximum' END AS keyword")),
    "checked_enum": (checked_enum, _LINES.format("CAST(l_linenumber AS SMALLINT) AS value, CASE WHEN l_linenumber NOT IN (1, 2, 7) THEN 'enum' END AS keyword, CASE WHEN l_linenumber NOT IN (1, 2, 7) THEN 1 END AS \"offset\", CAST(NULL AS INTEGER) AS enum_index")),
    "checked_wide_bound": (checked_wide_bound, _LINES.format("CASE WHEN l_linenumber <= 3 THEN '7922816251426433759354395033' || CAST(l_linenumber + 2 AS STRING) END AS value, CASE l_linenumber WHEN 3 THEN 'maximum' END AS keyword, CASE WHEN l_linenumber > 3 THEN 'out_of_range' END AS reason, CASE WHEN l_linenumber > 3 THEN 'too_large' END AS detail")),
    "as_spark_types": (as_spark_types, _LINES.format(f"CAST({_EPOCH_DAYS} * 86400000000 + {_HMS_SECONDS} * 1000000 + 500000 AS BIGINT) AS micros, CAST({_HMS_SECONDS} AS BIGINT) AS seconds")),
    "checked_text_enum": (checked_text_enum, f"SELECT c_custkey, CASE WHEN {_MK} IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN {_MK} ELSE lower({_MK}) END AS value, CASE WHEN length({_MK}) > 9 THEN 'maxLength' WHEN {_MK} NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'enum' END AS keyword, CASE {_MK} WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2 END AS enum_index FROM customer"),
}


def queries():
    return {c.name: c.spark for c in CASES} | {n: f for n, (f, _) in OTHERS.items()} | sites.queries()


def oracle_sql():
    return {c.name: c.sql() for c in CASES} | {n: s for n, (_, s) in OTHERS.items()} | sites.oracle_sql()
