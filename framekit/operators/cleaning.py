"""Cleaning: filled, mapped and filtered columns, dropped rows and columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OperationError
from ..functions.expressions import NUMBER, as_double, col, field, from_micros, is_integer, is_numeric, is_temporal, micros, nearest
from ..functions.groups import meet
from ..functions.ordered import fill, index
from ..functions.quantiles import group_medians, group_modes, quantiles

NUMERIC_MODES = ("constant", "mean", "avg", "average", "median", "mode", "std", "var", "variance", "min", "max", "ffill", "bfill")
CATEGORICAL_MODES = ("constant", "mode", "map", "ffill", "bfill")
DATETIME_MODES = ("constant", "now", "min", "max", "mean", "median", "mode", "ffill", "bfill")
SAME = {"avg": "mean", "average": "mean", "variance": "var"}


def _clean(x: object) -> str:
    return re.sub(r"\W", "_", str(x))


def family(df: DataFrame, column: str, dtype: str | None = None) -> str:
    """numeric, datetime or categorical: by ``dtype`` if given, else by the column's type."""
    if dtype:
        low = dtype.lower()
        if low in ("numeric", "number") or re.search("int|float|double|decimal|real", low):
            return "numeric"
        return "datetime" if re.search("date|time", low) else "categorical"
    kind = field(df, column).dataType
    return "numeric" if is_numeric(kind) else "datetime" if is_temporal(kind) else "categorical"


def _number(c: Column, kind: T.DataType, what: str) -> Column:
    """The column as numbers: times as microseconds, without the session's zone."""
    return as_double(c, kind) if what == "numeric" else micros(c.cast("timestamp_ntz"), T.TimestampNTZType())


def _value(number: Column, what: str) -> Column:
    return number if what == "numeric" else from_micros(nearest(number), T.TimestampNTZType())


def _statistic(c: Column, kind: T.DataType, mode: str, what: str) -> Column:
    """The aggregate that a fill mode other than median and mode stands for."""
    if what == "numeric":
        c = as_double(c, kind)
        return {"mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "min": F.min, "max": F.max}[mode](c)
    if mode == "mean":
        return _value(F.avg(_number(c, kind, what)), what)
    out = {"min": F.min, "max": F.max}[mode](c)
    return out.cast("timestamp_ntz") if what == "datetime" else out


def _counted(c: Column, kind: T.DataType, what: str) -> Column:
    """The column as its mode is taken."""
    return as_double(c, kind) if what == "numeric" else c.cast("timestamp_ntz") if what == "datetime" else c


def _whole(df: DataFrame, c: Column, kind: T.DataType, mode: str, what: str) -> Column:
    """The whole column's statistic, as a subquery of one row."""
    if mode == "median":
        return df.agg(_value(F.get(quantiles(df, [_number(c, kind, what)], [0.5])[0], F.lit(0)), what).alias("s")).scalar()
    if mode == "mode":
        # One row, or none for a column without values: an aggregate without keys gives one either way.
        return group_modes(df, [], _counted(c, kind, what)).scalar()
    return df.agg(_statistic(c, kind, mode, what).alias("s")).scalar()


def _of_groups(df: DataFrame, keys: Sequence[str], c: Column, kind: T.DataType, mode: str, what: str) -> DataFrame:
    """(__g0, __g1, ..., __s): each group's statistic."""
    own = [col(k) for k in keys]
    if mode == "median":
        found = group_medians(df, own, _number(c, kind, what))
        return found.withColumn("__s", _value(F.col("__s"), what))
    if mode == "mode":
        return group_modes(df, own, _counted(c, kind, what))
    return df.groupBy(*[k.alias(f"__g{i}") for i, k in enumerate(own)]).agg(_statistic(c, kind, mode, what).alias("__s"))


def _fit(value: Column, kind: T.DataType, what: str) -> Column:
    """A filled value in the type of the filled column."""
    if what == "datetime":
        return value.cast("timestamp_ntz")
    if what == "numeric" and is_integer(kind):
        return F.rint(value.cast("double")).cast(kind)
    return value.cast(kind)


def _modes(what: str) -> tuple[str, ...]:
    return {"numeric": NUMERIC_MODES, "categorical": CATEGORICAL_MODES, "datetime": DATETIME_MODES}[what]


def _checked(what: str, method: str) -> str:
    mode = method.lower()
    if mode not in _modes(what):
        raise OperationError(f"can't fill a {what} column by {method!r}")
    return SAME.get(mode, mode)


def _suffix(mode: str, what: str, value: object) -> str:
    if mode == "constant":
        return f"constant_filled_{_clean(value)}" if what == "numeric" else "constant_filled"
    return "mapped" if mode == "map" else f"{mode}_filled"


def _mapped(c: Column, mapping: Mapping) -> Column:
    out = c
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def fillna(df: DataFrame, column: str, value: object = None, method: str = "mean", mapping: Mapping | None = None, dtype: str | None = None, order_by: str | Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """``df`` with ``cleaned_<column>_<mode>``: the column with its NULLs filled.

    A ``value`` means constant, a ``mapping`` means map. Without any value a
    statistic is 0 for numbers. Filling forward or backward needs ``order_by``
    and runs range by range, not in one task.
    """
    what, kind = family(df, column, dtype), field(df, column).dataType
    mode = "map" if mapping is not None else "constant" if value is not None else method.lower()
    if mode == "map":
        what = "categorical"
    mode = _checked(what, mode)
    name = target or f"cleaned_{column}_{_suffix(mode, what, value)}"
    c = col(column)
    if mode in ("ffill", "bfill"):
        if order_by is None:
            raise OperationError(f"{mode} needs an order")
        out = fill(df, column, order_by, name, mode == "ffill")
        return out.withColumn(name, _fit(col(name), kind, what))
    if mode == "constant":
        filler = F.lit(value)
    elif mode == "now":
        filler = F.current_timestamp()
    elif mode == "map":
        return df.withColumn(name, _mapped(c, mapping or {}))
    else:
        filler = _whole(df, c, kind, mode, what)
        if what == "numeric":
            filler = F.coalesce(filler, F.lit(0.0))
    base = as_double(c, kind).cast(kind) if what == "numeric" and not is_numeric(kind) else c
    return df.withColumn(name, F.coalesce(base.cast("timestamp_ntz") if what == "datetime" else base, _fit(filler, kind, what)))


def _meet(df: DataFrame, per: DataFrame, keys: Sequence[str]) -> DataFrame:
    return meet(df, [col(k) for k in keys], per)


def groupby_fillna(df: DataFrame, column: str, group_cols: Sequence[str], value: object = None, method: str = "mean", dtype: str | None = None, order_by: str | Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """As ``fillna`` with each group's own statistic, then the whole column's, for what is left.

    NULL keys are a group. Group statistics are added up before the shuffle and
    joined back without dealing rows by group, so a group of a third of all rows
    isn't one task's work.
    """
    keys = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    if not keys:
        raise OperationError("no group columns")
    what, kind = family(df, column, dtype), field(df, column).dataType
    mode = _checked(what, "constant" if value is not None else method)
    name = target or f"cleaned_{column}_{_suffix(mode, what, value)}"
    if mode in ("constant", "now", "map"):
        return fillna(df, column, value, mode, None, dtype, None, name)
    c = col(column)
    if mode in ("ffill", "bfill"):
        if order_by is None:
            raise OperationError(f"{mode} needs an order")
        out = fill(df, column, order_by, name, mode == "ffill", keys)
        return out.withColumn(name, _fit(col(name), kind, what))
    per = _of_groups(df, keys, c, kind, mode, what)
    whole = _whole(df, c, kind, mode, what)
    last = F.lit(0.0) if what == "numeric" else F.current_timestamp() if what == "datetime" else F.lit(None)
    filler = F.coalesce(_fit(F.col("__s"), kind, what), _fit(whole, kind, what), _fit(last, kind, what))
    base = c.cast("timestamp_ntz") if what == "datetime" else c
    return _meet(df, per, keys).withColumn(name, F.coalesce(base, filler)).drop("__s")


def clip(df: DataFrame, column: str, lower: object = None, upper: object = None, target: str | None = None) -> DataFrame:
    """Values outside the range become NULL."""
    if is_temporal(field(df, column).dataType):
        return clip_dates(df, column, lower, upper, target)
    c = col(column)
    outside = F.lit(False)
    if lower is not None:
        outside = outside | (c < F.lit(lower))
    if upper is not None:
        outside = outside | (c > F.lit(upper))
    return df.withColumn(target or f"cleaned_{column}_range_{_clean(lower)}_{_clean(upper)}", F.when(~outside, c))


def drop_outliers(df: DataFrame, column: str, z_thresh: float = 3.0, target: str | None = None) -> DataFrame:
    """Values over ``z_thresh`` population deviations from the mean become NULL; without spread all stay."""
    c = as_double(col(column), field(df, column).dataType)
    one = df.agg(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias("z")).scalar()
    far = F.abs(F.try_divide(c - one["m"], F.when(one["s"] != 0, one["s"]))) > float(z_thresh)
    return df.withColumn(target or f"cleaned_{column}_outliers_removed", F.when(~F.coalesce(far, F.lit(False)), col(column)))


def _digits(c: Column) -> Column:
    """The text without characters that no number has, or NULL where no number is left."""
    text = F.regexp_replace(c.cast("string"), r"[^0-9.+-]", "")
    return F.when(text.rlike(NUMBER), F.trim(text))


def numeric_type(df: DataFrame, column: str) -> str:
    """The narrowest of int, bigint and double that holds all numbers of a column, over all its rows; a numeric column keeps its type."""
    kind = field(df, column).dataType
    if is_numeric(kind):
        return kind.simpleString()
    text = _digits(col(column))
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text)
    one = df.agg(F.count(text).alias("all"), *[F.count(whole.try_cast(k)).alias(k) for k in ("int", "bigint")]).first()
    return next((k for k in ("int", "bigint") if one["all"] and one[k] == one["all"]), "double")


def to_numeric(df: DataFrame, column: str, dtype: str = "double") -> DataFrame:
    """The column itself as numbers: other characters are stripped, what is no number is NULL.

    Whole numbers go from text to an integer type digit by digit; a numeric
    column is cast.
    """
    kind = field(df, column).dataType
    if is_numeric(kind):
        c = col(column)
        return df.withColumn(column, (F.rint(c.cast("double")) if "int" in dtype and not is_integer(kind) else c).try_cast(dtype))
    text = _digits(col(column))
    if "int" in dtype:
        return df.withColumn(column, F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(dtype)).otherwise(F.rint(text.try_cast("double")).try_cast(dtype)))
    return df.withColumn(column, text.try_cast(dtype))


def map_values(df: DataFrame, column: str, mapping: Mapping, target: str | None = None) -> DataFrame:
    """Mapped values; others stay."""
    return df.withColumn(target or f"cleaned_{column}_mapped_{_clean('_'.join(map(str, mapping)))}", _mapped(col(column), mapping))


def filter_valid(df: DataFrame, column: str, valid_values: Sequence, target: str | None = None) -> DataFrame:
    """Values not in the list become NULL."""
    keep = col(column).isin(list(valid_values)) if valid_values else F.lit(False)
    return df.withColumn(target or f"cleaned_{column}_valid_values_{_clean('_'.join(map(str, valid_values)))}", F.when(keep, col(column)))


def compress_rare(df: DataFrame, column: str, min_count: int = 10, other_label: str = "other", target: str | None = None) -> DataFrame:
    """Values that occur less than ``min_count`` times become the label; NULL stays."""
    n = df.groupBy(col(column).alias("__g0")).agg(F.count(F.lit(1)).alias("__n"))
    name = target or f"cleaned_{column}_compressed"
    c = col(column)
    return _meet(df, n, [column]).withColumn(name, F.when(c.isNull(), None).when(F.col("__n") < min_count, F.lit(other_label)).otherwise(c.cast("string"))).drop("__n")


def fix_dates(df: DataFrame, column: str, target: str | None = None) -> DataFrame:
    """Text dates as dates; ``0000-00-00`` and what is no date are NULL."""
    text = col(column).cast("string")
    return df.withColumn(target or f"cleaned_{column}_fixed", F.when(text != "0000-00-00", text.try_cast("date")))


def clip_dates(df: DataFrame, column: str, min_dt: object = None, max_dt: object = None, target: str | None = None) -> DataFrame:
    """Dates outside the inclusive range become NULL; without any bound 1900-01-01 to 2100-01-01 holds."""
    if min_dt is None and max_dt is None:
        min_dt, max_dt = "1900-01-01", "2100-01-01"
    d = col(column).try_cast("date")
    inside = F.lit(True)
    if min_dt is not None:
        inside = inside & (d >= F.lit(str(min_dt)).cast("date"))
    if max_dt is not None:
        inside = inside & (d <= F.lit(str(max_dt)).cast("date"))
    return df.withColumn(target or f"cleaned_{column}_range_filtered", F.when(inside, d))


def dropna(df: DataFrame, axis: int = 0, how: str = "any", thresh: int | float | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (axis 0) or columns (axis 1) without NULLs, without only NULLs, or with at least ``thresh`` values.

    A float is the greatest share of NULLs that is let pass: of columns for
    rows, of rows for columns. Columns come from one aggregate.
    """
    if axis not in (0, 1) or how not in ("any", "all"):
        raise OperationError("axis must be 0 or 1, how must be any or all")
    names = list(columns) if columns else df.columns
    if axis == 0:
        if isinstance(thresh, float):
            thresh = int(round(len(names) * (1 - thresh)))
        return df.dropna(thresh=int(thresh), subset=names) if thresh is not None else df.dropna(how=how, subset=names)
    n = df.agg(F.count(F.lit(1)).alias("__all"), *[F.count(col(c)).alias(f"v{i}") for i, c in enumerate(names)]).first()
    total = n["__all"]
    need = thresh if isinstance(thresh, int) else int(total * (1 - thresh)) if thresh is not None else total if how == "any" else 1
    return df.select(*[col(c) for c in df.columns if c not in names or n[f"v{names.index(c)}"] >= need])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The other columns; unknown names and dropping all are errors."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise OperationError(f"no columns {missing}")
    rest = [c for c in df.columns if c not in columns]
    if not rest:
        raise OperationError("can't drop all columns")
    return df.select(*[col(c) for c in rest])


def drop_rows(df: DataFrame, positions: Sequence[int], order_by: str | Sequence[str], dense: bool = False) -> DataFrame:
    """The rows whose places, in order, aren't listed. ``dense``: the order's column is the place itself."""
    if dense:
        return df.where(~col(order_by).isin(list(positions)))
    return index(df, order_by, "__at").where(~F.col("__at").isin(list(positions))).drop("__at")


def isna(df: DataFrame) -> DataFrame:
    return df.select(*[col(c).isNull().alias(c) for c in df.columns])


def notna(df: DataFrame) -> DataFrame:
    return df.select(*[col(c).isNotNull().alias(c) for c in df.columns])


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first", order_by: str | Sequence[str] | None = None) -> DataFrame:
    """One row of each group of equal keys: the first or last in order, or none of those that repeat (``keep=False``).

    NULLs are equal. Spark drops all but one row of a key before the shuffle.
    """
    keys = list(subset) if subset else [c for c in df.columns if c != order_by]
    if keep is False:
        alone = df.groupBy(*[col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*[col(c) for c in df.columns])).alias("__row"))
        return alone.where("__n = 1").select("__row.*")
    if keep not in ("first", "last"):
        raise OperationError("keep must be first, last or False")
    order = [order_by] if isinstance(order_by, str) else list(order_by or df.columns)
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[col(c).asc() if keep == "first" else col(c).desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
