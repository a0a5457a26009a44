"""DataFrame operations on verdict columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.doors import cast_door


def is_ok(verdict) -> Column:
    return (F.col(verdict) if isinstance(verdict, str) else verdict)["ok"]


def faults(df: DataFrame, verdict: str, *keys: str) -> DataFrame:
    """Rows whose text isn't of the type: keys, reason, offset, length, detail."""
    v = F.col(verdict)
    return df.where(v["reason"].isNotNull()).select(*keys, *[v[f].alias(f) for f in ("reason", "offset", "length", "detail")])


def violations(df: DataFrame, verdict: str, *keys: str) -> DataFrame:
    """Rows whose value breaks a keyword: keys, keyword, value, offset, length."""
    v = F.col(verdict)
    return df.where(v["keyword"].isNotNull()).select(*keys, *[v[f].alias(f) for f in ("keyword", "value", "offset", "length")])


def optional(verdict) -> Column:
    """An empty text is absent: the verdict is null where the reason is 'empty'."""
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    return F.when(v["reason"].isNull() | (v["reason"] != "empty"), v)


def split_good_bad(df: DataFrame, verdict: str) -> tuple[DataFrame, DataFrame]:
    """Rows that cast (missing ones among them) and rows that don't."""
    ok = F.coalesce(F.col(verdict)["ok"], F.lit(True))
    return df.where(ok), df.where(~ok)


def summary(df: DataFrame, verdict: str) -> DataFrame:
    """One row: n_ok, n_faulted, n_missing."""
    v = F.col(verdict)
    return df.agg(F.count_if(v["ok"]).alias("n_ok"), F.count_if(~v["ok"]).alias("n_faulted"), F.count_if(v.isNull()).alias("n_missing"))


def fault_profile(df: DataFrame, verdict: str) -> DataFrame:
    """Rows by reason and detail."""
    v = F.col(verdict)
    return df.groupBy(v["reason"].alias("reason"), v["detail"].alias("detail")).agg(F.count(F.lit(1)).alias("n"))


def as_decimal(value, precision: int, scale: int) -> Column:
    """A decimal value as DecimalType; null where that would not be exact."""
    v = F.col(value) if isinstance(value, str) else value
    fits = F.length(F.regexp_extract(v["text"], "[.]([0-9]*)", 1)) <= scale
    return F.when(fits, v["text"]).try_cast(f"decimal({precision},{scale})")


def cast_schema(df: DataFrame, doors: dict[str, dict]) -> DataFrame:
    """Each named column replaced by its verdict; the dict has cast_door's arguments, door among them."""
    return df.withColumns({c: cast_door(F.col(c), **how) for c, how in doors.items()})
