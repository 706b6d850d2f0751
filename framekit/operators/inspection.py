"""Inspection: looks at rows, per-column reports in one pass, casts, mapped columns, updates and resampling."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OperationError
from ..functions.expressions import as_double, col, field, is_numeric, is_temporal, truncated, unit_of, unpivot
from ..functions.ordered import index
from ..functions.quantiles import group_medians, quantiles
from .stats import numeric_columns

CASTS = {
    "int": "int", "int8": "int", "int16": "int", "int32": "int", "int64": "bigint", "float": "float", "float32": "float",
    "float64": "double", "double": "double", "str": "string", "string": "string", "text": "string",
}
AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MEAN": F.avg, "MIN": F.min, "MAX": F.max, "MEDIAN": F.median, "STDDEV": F.stddev_samp, "STD": F.stddev_samp, "VAR": F.var_samp}
STEPS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def _chosen(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = [c for c in (columns or []) if c in df.columns]
    return names or df.columns


def head(df: DataFrame, n: int = 10, columns: Sequence[str] | None = None, order_by: str | Sequence[str] = "__pos") -> DataFrame:
    """The first rows in order; unknown columns are ignored."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[col(k).asc() for k in keys]).limit(n).select(*[col(c) for c in _chosen(df, columns)])


def tail(df: DataFrame, n: int = 10, columns: Sequence[str] | None = None, order_by: str | Sequence[str] = "__pos") -> DataFrame:
    """The last rows, in order."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    last = df.orderBy(*[col(k).desc() for k in keys]).limit(n)
    return last.orderBy(*[col(k).asc() for k in keys]).select(*[col(c) for c in _chosen(df, columns)])


def sample(df: DataFrame, n: int = 10, columns: Sequence[str] | None = None, random_state: int | None = None, key: str | None = None) -> DataFrame:
    """``n`` rows at random; with a seed the same ones each time, by a hash of ``key`` (all columns by default)."""
    if random_state is None:
        order: Column = F.rand()
    else:
        order = F.xxhash64(F.lit(random_state), *[col(c) for c in ([key] if key else df.columns)])
    return df.orderBy(order, *([col(key)] if key else [])).limit(n).select(*[col(c) for c in _chosen(df, columns)])


def info(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(name, type, null_count, non_null_count, null_percentage, distinct_count) of every column.

    Each column is counted by value on its own, which reads every column once
    and shuffles its distinct values alone. ``approximate`` takes sketches of
    distinct values instead, for all columns in one aggregate.
    """
    names = df.columns
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if approximate:
        parts = [x for i, c in enumerate(names) for x in (F.count(col(c)).alias(f"n{i}"), F.approx_count_distinct(col(c)).alias(f"d{i}"))]
        one = df.agg(F.count(F.lit(1)).alias("all"), *parts)
        counts = unpivot(one, [(F.lit(c), F.lit(kinds[c]), F.col("all"), F.col(f"n{i}"), F.col(f"d{i}")) for i, c in enumerate(names)], ("name", "type", "all", "known", "distinct"))
    else:
        counts = None
        for c in names:
            by_value = df.groupBy(col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            known = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
            own = by_value.agg(F.lit(c).alias("name"), F.lit(kinds[c]).alias("type"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"), known.alias("known"), F.count("v").alias("distinct"))
            counts = own if counts is None else counts.unionByName(own)
    nulls = F.col("all") - F.col("known")
    share = F.when(F.col("all") > 0, F.round(nulls.cast("double") * 100.0 / F.col("all"), 2))
    return counts.select("name", "type", nulls.alias("null_count"), F.col("known").alias("non_null_count"), share.alias("null_percentage"), F.col("distinct").alias("distinct_count"))


STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of numeric columns: one row a statistic."""
    names = numeric_columns(df, columns)
    if not names:
        raise OperationError("no numeric columns")
    parts, quarters = [], quantiles(df, [col(c).cast("double") for c in names], [0.25, 0.5, 0.75])
    for i, c in enumerate(names):
        x = col(c).cast("double")
        parts += [F.count(x).cast("double").alias(f"c{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), quarters[i].alias(f"q{i}")]
    one = df.agg(*parts)
    pick = {"count": "c", "mean": "a", "std": "s", "min": "l", "max": "h"}
    rows = []
    for k in STATISTICS:
        cells = [F.col(f"{pick[k]}{i}") if k in pick else F.get(f"q{i}", F.lit(("25%", "50%", "75%").index(k))) for i in range(len(names))]
        rows.append((F.lit(k), *cells))
    return unpivot(one, rows, ("statistic", *names))


def null_analysis(df: DataFrame, columns: Sequence[str] | str | None = None) -> DataFrame:
    """(column_name, contains_null, percent_missing) of the columns, in one aggregate."""
    names = df.columns if columns in (None, "*") else list(columns)
    one = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)])
    rows = []
    for i, c in enumerate(names):
        nulls = F.col("all") - F.col(f"n{i}")
        rows.append((F.lit(c), nulls > 0, F.when(F.col("all") > 0, F.round(nulls.cast("double") * 100.0 / F.col("all"), 2)).otherwise(F.lit(0.0))))
    return unpivot(one, rows, ("column_name", "contains_null", "percent_missing"))


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, total, non_null, missing, missing_pct, completeness) of the columns, in one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = []
    for i, c in enumerate(columns):
        known = F.col(f"n{i}")
        full = F.when(F.col("all") > 0, known.cast("double") * 100.0 / F.col("all"))
        missing = F.when(F.col("all") > 0, (F.col("all") - known).cast("double") * 100.0 / F.col("all"))
        rows.append((F.lit(c), F.col("all"), known, F.col("all") - known, missing, full))
    return unpivot(one, rows, ("column_name", "total", "non_null", "missing", "missing_pct", "completeness"))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, completeness) in per cent."""
    return missing_values(df, columns).select("column_name", "completeness")


def numeric_summary(df: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """describe turned round, a row a column, with missing values; of all columns, or of the first ``most``."""
    numbers = set(numeric_columns(df, columns))
    names = [c for c in list(columns)[:most] if c in numbers]
    if not names:
        raise OperationError("no numeric columns")
    parts, quarters = [F.count(F.lit(1)).alias("all")], quantiles(df, [col(c).cast("double") for c in names], [0.25, 0.5, 0.75])
    for i, c in enumerate(names):
        x = col(c).cast("double")
        parts += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), quarters[i].alias(f"q{i}")]
    one = df.agg(*parts)
    rows = [(F.lit(c), F.col(f"c{i}"), F.col("all") - F.col(f"c{i}"), F.col(f"a{i}"), F.col(f"s{i}"), F.col(f"l{i}"), *[F.get(f"q{i}", F.lit(k)) for k in range(3)], F.col(f"h{i}")) for i, c in enumerate(names)]
    return unpivot(one, rows, ("column_name", "count", "nulls", "mean", "std", "min", "q25", "q50", "q75", "max"))


def astype(df: DataFrame, columns: Sequence[str] | str | None = None, dtypes: Sequence[str] | str | None = None, dtype_map: Mapping[str, str] | None = None) -> DataFrame:
    """Only the cast columns; a value that doesn't fit is an error."""
    if dtype_map is None:
        names = [columns] if isinstance(columns, str) else list(columns or [])
        kinds = [dtypes] * len(names) if isinstance(dtypes, str) else list(dtypes or [])
        if not names or len(names) != len(kinds):
            raise OperationError("columns and dtypes must go together")
        dtype_map = dict(zip(names, kinds))
    out = []
    for name, kind in dtype_map.items():
        if kind.lower() not in CASTS:
            raise OperationError(f"unknown type {kind!r}")
        own, c = field(df, name).dataType, col(name)
        if kind.lower().startswith("int") and is_numeric(own):
            c = F.rint(c.cast("double"))
        out.append(c.cast(CASTS[kind.lower()]).alias(name))
    return df.select(*out)


def insert(df: DataFrame, column: str, value: Sequence, order_by: str | Sequence[str] = "__pos", dense: bool = True) -> DataFrame:
    """``df`` with a new column whose values follow the rows' order; there must be one for each row."""
    rows = df if dense else index(df, order_by, "__at")
    at = order_by if dense else "__at"
    if (n := df.count()) != len(value):
        raise OperationError(f"{len(value)} values for {n} rows")
    known = [v for v in value if v is not None]
    kind = "boolean" if known and all(isinstance(v, bool) for v in known) else "bigint" if known and all(isinstance(v, int) for v in known) else "double" if known and all(isinstance(v, (int, float)) for v in known) else "string"
    cast = {"double": float, "string": str}.get(kind, lambda v: v)
    own = df.sparkSession.createDataFrame([(i, None if v is None else cast(v)) for i, v in enumerate(value)], f"__i bigint, __v {kind}")
    return rows.join(own, col(at) == F.col("__i"), "left").drop("__i", *([] if dense else ["__at"])).withColumnRenamed("__v", column)


TEXT_FUNCTIONS = re.compile(r"\b(upper|lower|length|trim)\s*\(", re.IGNORECASE)


def map_columns(df: DataFrame, func: str, na_action: str | None = None, columns: Sequence[str] | None = None, datetime_action: str = "skip") -> DataFrame:
    """Only the mapped columns: an SQL expression of ``x`` on each column that it suits.

    Numbers always; text only for UPPER, LOWER, LENGTH and TRIM; truth values as
    0 and 1 in arithmetic; dates by ``datetime_action``: skip, keep,
    cast_string, extract_epoch or error.
    """
    out = []
    for f in df.schema.fields:
        if columns and f.name not in columns:
            continue
        text = bool(TEXT_FUNCTIONS.search(func))
        name = "`" + f.name.replace("`", "``") + "`"
        value: Column | None = None
        if is_temporal(f.dataType):
            if datetime_action == "error":
                raise OperationError(f"column {f.name!r} is a date or time")
            if datetime_action == "keep":
                value = col(f.name)
            elif datetime_action == "cast_string":
                value = F.expr(re.sub(r"\bx\b", f"CAST({name} AS STRING)", func))
            elif datetime_action == "extract_epoch":
                value = F.expr(re.sub(r"\bx\b", f"(unix_micros(CAST({name} AS TIMESTAMP)) / 1e6D)", func))
        elif is_numeric(f.dataType):
            value = F.expr(re.sub(r"\bx\b", name, func))
        elif isinstance(f.dataType, T.StringType) and text:
            value = F.expr(re.sub(r"\bx\b", name, func))
        elif isinstance(f.dataType, T.BooleanType):
            value = F.expr(re.sub(r"\bx\b", f"CAST({name} AS INT)" if re.search(r"[-+*/%]", func) else name, func))
        if value is not None:
            out.append((F.when(col(f.name).isNotNull(), value) if na_action == "ignore" else value).alias(f.name))
    if not out:
        raise OperationError("no column suits the expression")
    return df.select(*out)


def rename(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise OperationError(f"no columns {missing}")
    return df.withColumnsRenamed(dict(columns))


def check_index(df: DataFrame, columns: Sequence[str]) -> None:
    """An error unless the columns are never NULL and together unique."""
    found = df.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
    bad = found.where((F.col("__n") > 1) | F.greatest(F.lit(False), *[col(c).isNull() for c in columns])).limit(1).count()
    if bad:
        raise OperationError("an index must be unique and without NULLs")


def update(df: DataFrame, other: DataFrame, on: str, overwrite: bool = True, errors: str = "ignore") -> DataFrame:
    """``df`` with values of ``other`` where keys meet: those that aren't NULL, or only into NULLs.

    A key that ``other`` repeats takes one of its rows, the greatest. Rows of
    ``df`` neither grow nor go. ``errors="raise"`` refuses two values for a cell.
    """
    if errors not in ("ignore", "raise"):
        raise OperationError("errors must be ignore or raise")
    shared = [c for c in df.columns if c in other.columns and c != on]
    if not shared:
        return df
    row = F.struct(*[col(c) for c in shared])
    source = other.where(col(on).isNotNull()).groupBy(col(on).alias("__on")).agg(F.max(row).alias("__o"))
    joined = df.join(source, col(on) == F.col("__on"), "left")
    theirs = {c: F.col("__o")[c] for c in shared}
    if errors == "raise":
        clash = F.greatest(F.lit(False), *[col(c).isNotNull() & theirs[c].isNotNull() for c in shared])
        if joined.where(clash).limit(1).count():
            raise OperationError("both sides have values")
    pick = lambda c: F.coalesce(theirs[c], col(c)) if overwrite else F.coalesce(col(c), theirs[c])
    return joined.select(*[pick(c).cast(field(df, c).dataType).alias(c) if c in shared else col(c) for c in df.columns])


def resample(df: DataFrame, time_column: str, rule: str, agg: str = "COUNT", value_column: str | None = None, label: str = "left", closed: str = "left") -> DataFrame:
    """(time_column, value): one aggregate for each unit of time that has rows, in order.

    ``label="right"`` names a unit by its end; ``closed="right"`` counts a unit's
    first instant to the unit before.
    """
    if label not in ("left", "right") or closed not in ("left", "right"):
        raise OperationError("label and closed must be left or right")
    unit, name = unit_of(rule), agg.upper()
    if name not in AGGREGATES:
        raise OperationError(f"unknown aggregate {agg!r}")
    if name != "COUNT" and value_column is None:
        raise OperationError(f"{agg} needs a value column")
    t = col(time_column).cast("timestamp_ntz")
    if closed == "right":
        t = t - F.expr("INTERVAL '0.000001' SECOND")
    bucket = truncated(t, unit)
    if label == "right":
        bucket = bucket + F.expr(f"INTERVAL {STEPS[unit]}")
    rows = df.where(col(time_column).isNotNull())
    value = None if value_column is None else col(value_column) if name == "COUNT" else as_double(col(value_column), field(df, value_column).dataType)
    if name == "MEDIAN":
        found = group_medians(rows, [bucket], value)
        # Units whose values are all NULL have rows as well.
        units = rows.groupBy(bucket.alias(time_column)).agg(F.lit(1).alias("__u"))
        return units.join(found, col(time_column) == F.col("__g0"), "left").select(col(time_column), F.col("__s").alias("value")).orderBy(time_column)
    value = F.count(F.lit(1)) if value is None else AGGREGATES[name](value)
    return rows.groupBy(bucket.alias(time_column)).agg(value.alias("value")).orderBy(time_column)


def items(df: DataFrame):
    """(column, iterator of its values) for each column, without collecting either."""
    for c in df.columns:
        yield c, (r[0] for r in df.select(col(c)).toLocalIterator())
