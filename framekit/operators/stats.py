"""Statistics of columns: one-row or long frames, NULLs skipped, one pass unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OperationError
from ..functions.expressions import SECONDS, as_double, col, epoch, field, from_micros, is_numeric, is_temporal, kurtosis, micros, nearest, pair_mask, safe_corr, skewness, unpivot
from ..functions.ordered import shift
from ..functions.quantiles import quantiles

#: Expressions in one aggregate; wider reports take several.
CHUNK = 400

NUMERIC: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c).cast("double")),
    "range": lambda c: F.max(c) - F.min(c),
    "skew": skewness,
    "kurtosis": kurtosis,
    "coefficient_of_variation": lambda c: F.stddev_pop(c) / F.nullif(F.avg(c), F.lit(0.0)),
    "product": lambda c: F.exp(F.sum(F.when(c > 0, F.log(c)))),
}
ANY: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "nunique": F.count_distinct,
    "min": F.min,
    "max": F.max,
}


def numeric(df: DataFrame, column: str) -> Column:
    """The column as a number; text is read as numbers, other types are an error."""
    f = field(df, column)
    if is_numeric(f.dataType):
        return col(column)
    if isinstance(f.dataType, T.StringType):
        return as_double(col(column), f.dataType)
    raise OperationError(f"column {column!r} isn't numeric")


def scalar(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row, ``value``: a statistic of one column."""
    f = field(df, column)
    if name in ANY:
        return df.agg(ANY[name](col(column)).alias("value"))
    if name in ("mean", "median"):
        if is_temporal(f.dataType):
            m = micros(col(column), f.dataType)
            value = F.avg(m) if name == "mean" else F.get(quantiles(df, [m], [0.5])[0], F.lit(0))
            return df.agg(from_micros(nearest(value), f.dataType).alias("value"))
        c = numeric(df, column).cast("double")
        return df.agg((F.avg(c) if name == "mean" else F.get(quantiles(df, [c], [0.5])[0], F.lit(0))).alias("value"))
    if name == "iqr":
        q = quantiles(df, [numeric(df, column).cast("double")], [0.25, 0.75])[0]
        return df.agg((F.get(q, F.lit(1)) - F.get(q, F.lit(0))).alias("value"))
    if name == "mad":
        c = numeric(df, column).cast("double")
        centre = df.agg(F.avg(c).alias("m")).scalar()
        return df.agg(F.avg(F.abs(c - centre)).alias("value"))
    if name == "entropy":
        n = df.where(col(column).isNotNull()).groupBy(col(column).alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        return n.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("value"))
    if name not in NUMERIC:
        raise OperationError(f"unknown statistic {name!r}")
    c = numeric(df, column)
    return df.agg(NUMERIC[name](c if name in ("sum", "range") else c.cast("double")).alias("value"))


def frequencies(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """(value, n) of non-NULL values, the commonest first, ties by value."""
    out = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    return out if top_n is None else out.limit(top_n)


def mode(df: DataFrame, column: str, top_n: int = 1) -> DataFrame:
    """(value, n): the ``top_n`` commonest values."""
    return frequencies(df, column, top_n)


value_counts = frequencies


def unique(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values in order."""
    return df.select(col(column).alias("value")).where("value is not null").distinct().orderBy("value")


def proportions(df: DataFrame, column: str) -> DataFrame:
    """(value, share) of non-NULL values, the commonest first."""
    total = df.agg(F.count(col(column)).cast("double").alias("t")).scalar()
    return frequencies(df, column).select("value", (F.col("n") / total).alias("share"))


def quantile(df: DataFrame, column: str, q: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(q, value): exact, interpolated quantiles."""
    c = numeric(df, column).cast("double")
    one = df.agg(quantiles(df, [c], list(q))[0].alias("v"))
    return unpivot(one, [(F.lit(float(x)), F.get("v", F.lit(i))) for i, x in enumerate(q)], ("q", "value"))


def outliers_iqr(df: DataFrame, column: str) -> DataFrame:
    """q1, q3, iqr and bounds of 1.5 iqr around them."""
    c = numeric(df, column).cast("double")
    one = df.agg(quantiles(df, [c], [0.25, 0.75])[0].alias("p")).select(F.get("p", F.lit(0)).alias("q1"), F.get("p", F.lit(1)).alias("q3"))
    one = one.withColumn("iqr", F.col("q3") - F.col("q1"))
    return one.select(F.lit(column).alias("column"), "q1", "q3", "iqr", (F.col("q1") - 1.5 * F.col("iqr")).alias("lower_bound"), (F.col("q3") + 1.5 * F.col("iqr")).alias("upper_bound"))


def outliers_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Mean, population deviation and bounds of ``threshold`` deviations."""
    c = numeric(df, column).cast("double")
    one = df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
    t = float(threshold)
    return one.select(F.lit(column).alias("column"), "mean", "std", F.lit(t).alias("threshold"), (F.col("mean") - t * F.col("std")).alias("lower_bound"), (F.col("mean") + t * F.col("std")).alias("upper_bound"))


def autocorr(df: DataFrame, column: str, order_by: str | Sequence[str], lag: int = 1) -> DataFrame:
    """One row, ``value``: correlation of the column with itself ``lag`` rows before, in order."""
    rows = df.select(*dict.fromkeys([column, *([order_by] if isinstance(order_by, str) else order_by)]))
    return shift(rows, column, lag, order_by, "__before").agg(safe_corr(numeric(rows, column).cast("double"), F.col("__before").cast("double")).alias("value"))


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    names = list(columns) if columns else df.columns
    return [f.name for f in df.schema.fields if f.name in names and is_numeric(f.dataType)]


def _pairs(df: DataFrame, columns: Sequence[str] | None, of: Callable[[Column, Column], Column]) -> DataFrame:
    names = sorted(numeric_columns(df, columns), key=(list(columns) if columns else df.columns).index)
    if not names:
        raise OperationError("no numeric columns")
    pairs = list(combinations_with_replacement(names, 2))
    out = None
    for a in range(0, len(pairs), CHUNK):
        part = pairs[a : a + CHUNK]
        one = df.agg(*[of(col(x).cast("double"), col(y).cast("double")).alias(f"v{i}") for i, (x, y) in enumerate(part)])
        rows = [(F.lit(x), F.lit(y), F.col(f"v{i}")) for i, (x, y) in enumerate(part)]
        rows += [(F.lit(y), F.lit(x), F.col(f"v{i}")) for i, (x, y) in enumerate(part) if x != y]
        long = unpivot(one, rows, ("col_a", "col_b", "value"))
        out = long if out is None else out.unionByName(long)
    return out


def corr(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, value): Pearson's r of every pair of numeric columns over complete pairs."""
    return _pairs(df, columns, safe_corr)


def cov(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, value): sample covariance of every pair of numeric columns over complete pairs."""
    return _pairs(df, columns, lambda a, b: F.covar_samp(*pair_mask(a, b)))


def crosstab(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of each combination of values that occurs."""
    return df.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))


# Dates and times


def _temporal(df: DataFrame, column: str) -> Column:
    f = field(df, column)
    if is_temporal(f.dataType):
        return col(column)
    if isinstance(f.dataType, T.StringType):
        return col(column).try_cast("timestamp")
    raise OperationError(f"column {column!r} isn't a date or time")


def datetime_diff(df: DataFrame, column: str, target: str | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """``df`` with the seconds since the value before, in order of the column."""
    name = target or f"{column}__diff_seconds"
    rows = df.withColumn("__t", _temporal(df, column))
    kind = field(rows, "__t").dataType
    known, rest = rows.where("__t is not null"), rows.where("__t is null")
    lagged = shift(known, "__t", 1, ["__t", *tiebreak], "__before")
    out = lagged.withColumn(name, epoch(F.col("__t"), kind) - epoch(F.col("__before"), kind)).drop("__t", "__before")
    return out.unionByName(rest.withColumn(name, F.lit(None).cast("double")).drop("__t"))


def time_delta_stats(df: DataFrame, column: str) -> DataFrame:
    """Count, least, greatest, mean, median and population deviation of the gaps between values in order, in seconds.

    The gaps are worked out once and kept while their one row is made.
    """
    rows = df.select(_temporal(df, column).alias("t")).where("t is not null")
    kind = field(rows, "t").dataType
    gap = shift(rows, "t", 1, "t", "before").select((epoch(F.col("t"), kind) - epoch(F.col("before"), kind)).alias("d"))
    gap.persist()
    try:
        median = F.get(quantiles(gap, [F.col("d")], [0.5])[0], F.lit(0))
        out = gap.agg(F.count("d").alias("cnt"), F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.avg("d").alias("avg_d"), median.alias("median_d"), F.stddev_pop("d").alias("std_d"))
        return df.sparkSession.createDataFrame([tuple(out.first())], out.schema)
    finally:
        gap.unpersist()


def event_rate(df: DataFrame, column: str, unit: str = "day") -> DataFrame:
    """One row, ``value``: events in each unit of the time spanned; 0 if none is spanned."""
    rows = df.select(_temporal(df, column).alias("t"))
    t = epoch(F.col("t"), field(rows, "t").dataType)
    span = (F.max(t) - F.min(t)) / float(SECONDS.get(unit, SECONDS["day"]))
    return rows.agg(F.when(span > 0, F.count(t) / span).otherwise(F.lit(0.0)).alias("value"))


PARTS: dict[str, Callable[[Column], Column]] = {
    "hour": F.hour,
    "day": F.dayofmonth,
    "month": F.month,
    "year": F.year,
    "dow": lambda c: F.dayofweek(c) - 1,
    "quarter": F.quarter,
}


def time_unit_counts(df: DataFrame, column: str, unit: str = "day") -> DataFrame:
    """(unit, n): rows by hour, day of month, month, year, day of week (0 is Sunday) or quarter; unknown units mean day."""
    t = _temporal(df, column)
    part = PARTS.get(unit, PARTS["day"])(t).cast("bigint")
    return df.where(t.isNotNull()).groupBy(part.alias("unit")).agg(F.count(F.lit(1)).alias("n")).orderBy("unit")


def weekday_weekend_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: rows on weekdays and on weekends."""
    t = _temporal(df, column)
    weekend = F.dayofweek(t).isin(1, 7)
    return df.agg(F.count(F.when(t.isNotNull() & ~weekend, 1)).alias("weekday"), F.count(F.when(weekend, 1)).alias("weekend"))


def holiday_counts(df: DataFrame, column: str) -> DataFrame:
    """(kind, n): rows on New Year's Day, on Christmas Day and on other days."""
    t = _temporal(df, column)
    kind = F.when((F.month(t) == 1) & (F.dayofmonth(t) == 1), "New Year").when((F.month(t) == 12) & (F.dayofmonth(t) == 25), "Christmas").otherwise("non-holiday")
    return df.where(t.isNotNull()).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
