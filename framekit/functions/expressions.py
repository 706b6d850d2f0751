"""Column expressions with the semantics that the operators share."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OperationError

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

#: Spellings of units of time, and the unit that each means.
UNITS = {
    "second": ("s", "sec", "second", "seconds"),
    "minute": ("min", "t", "minute", "minutes"),
    "hour": ("h", "hour", "hours"),
    "day": ("d", "day", "days"),
    "week": ("w", "week", "weeks"),
    "month": ("m", "month", "months"),
    "quarter": ("q", "quarter", "quarters"),
    "year": ("y", "a", "year", "years"),
}
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise OperationError(f"no column {name!r}")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def as_double(c: Column, kind: T.DataType) -> Column:
    """A number as double; text that is no number is NULL."""
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    return c.cast("double")


def operand(df: DataFrame, x: str | int | float) -> tuple[Column, bool]:
    """(double expression, is a column) of a column name, a number or numeric text; a column's name wins."""
    if isinstance(x, str):
        if x in df.columns:
            return as_double(col(x), field(df, x).dataType), True
        if re.match(NUMBER, x):
            return F.lit(float(x)), False
        raise OperationError(f"no column {x!r}")
    return F.lit(float(x)), False


def unit_of(rule: str) -> str:
    """The unit of time that a rule names, whatever its spelling."""
    key = rule.strip().lower()
    for unit, names in UNITS.items():
        if key in names:
            return unit
    raise OperationError(f"unknown unit of time {rule!r}")


def micros(c: Column, kind: T.DataType | None) -> Column:
    """Microseconds since 1970 as bigint; dates and times without a zone never pass through the session's."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint") * 86_400_000_000
    t = c if isinstance(kind, T.TimestampNTZType) else c.cast("timestamp_ntz")
    seconds = F.date_part(F.lit("SECOND"), t).cast("decimal(10,6)")
    return F.unix_date(t.cast("date")).cast("bigint") * 86_400_000_000 + (F.hour(t) * 3600 + F.minute(t) * 60).cast("bigint") * 1_000_000 + (seconds * 1_000_000).cast("bigint")


def epoch(c: Column, kind: T.DataType | None = None) -> Column:
    """Seconds since 1970 as double, with microseconds."""
    return micros(c, kind or T.TimestampNTZType()).cast("double") / 1e6


def nearest(c: Column) -> Column:
    """A double as a whole number; halves go away from zero, as SQL's ``round`` has it (``rint`` takes them to the even number)."""
    return F.round(c.cast("double"))


def from_micros(micros: Column, kind: T.DataType) -> Column:
    """A temporal value of ``kind`` from whole microseconds."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(micros.cast("bigint"))
    whole = micros.cast("bigint")
    days = F.floor(whole / 86_400_000_000).cast("int")
    rest = whole - days.cast("bigint") * 86_400_000_000
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (rest.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    return (F.date_from_unix_date(days).cast("timestamp_ntz") + span).cast(kind)


#: Units of a date, by what they are truncated to.
CALENDAR = {"day": None, "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def truncated(t: Column, unit: str) -> Column:
    """The start of the unit that a time without a zone falls in; the session's zone plays no part."""
    day = t.cast("date")
    if unit in CALENDAR:
        return (F.trunc(day, CALENDAR[unit]) if CALENDAR[unit] else day).cast("timestamp_ntz")
    zero = F.lit(0)
    minutes = F.minute(t) if unit in ("minute", "second") else zero
    seconds = F.second(t) if unit == "second" else zero
    return day.cast("timestamp_ntz") + F.make_dt_interval(zero, F.hour(t), minutes, seconds.cast("decimal(18,6)"))


def truncate(c: Column, digits: int = 0) -> Column:
    """Digits beyond ``digits`` cut off, toward zero."""
    scale = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale).cast("double") / scale


def pair_mask(a: Column, b: Column) -> tuple[Column, Column]:
    """Both columns where neither is NULL."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's r over complete pairs; NULL if either side is constant."""
    a, b = pair_mask(a, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.when(spread != 0, spread)


def skewness(c: Column) -> Column:
    """Bias-corrected skewness; NULL for fewer than 3 values or no spread."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / F.when(n != 2, n - 2) * F.skewness(c))


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL for fewer than 4 values or no spread."""
    n = F.count(c).cast("double")
    below = (n - 2) * (n - 3)
    return F.when(n >= 4, (n - 1) / F.when(below != 0, below) * ((n + 1) * F.kurtosis(c) + 6))


def unpivot(df: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """One output row for each given row of expressions over a one-row frame."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(r, names)]) for r in rows]
    return df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
