"""Selection by label, by place, by type and as of a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OperationError
from ..functions.expressions import col, field, is_numeric
from ..functions.ordered import index


def at(df: DataFrame, row_label: object, column_label: str, index_column: str | None = None, order_by: str | None = None) -> DataFrame:
    """(value) of the row whose label is the one given; the label column is ``id`` or else the first.

    Of rows that repeat the label the first in ``order_by`` counts, without an order the one of least value.
    """
    name = index_column or ("id" if "id" in df.columns else df.columns[0])
    field(df, column_label)
    return df.where(col(name) == F.lit(row_label)).orderBy(col(order_by or column_label)).limit(1).select(col(column_label).alias("value"))


def iat(df: DataFrame, row_position: int, column_label: str, order_by: str | Sequence[str]) -> DataFrame:
    """(value) of one cell, by the row's place in order."""
    field(df, column_label)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[col(k).asc_nulls_last() for k in keys]).offset(row_position).limit(1).select(col(column_label).alias("value"))


def get(df: DataFrame, keys: Sequence[str] | str, default: object = None) -> DataFrame:
    """The columns asked for; missing ones hold the default, and if none exists there is one row of it."""
    names = [keys] if isinstance(keys, str) else list(keys)
    have = [k for k in names if k in df.columns]
    if not have:
        return df.sparkSession.range(1).select(*[F.lit(default).alias(k) for k in names])
    return df.select(*[col(k) if k in have else F.lit(default).alias(k) for k in names])


def family(kind: T.DataType) -> str:
    if is_numeric(kind):
        return "numeric"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "other"


def select_dtypes(df: DataFrame, include: Sequence[str] | str | None = None, exclude: Sequence[str] | str | None = None) -> DataFrame:
    """Columns of the families included and not excluded, in alphabetical order."""
    want = {include} if isinstance(include, str) else set(include or ())
    avoid = {exclude} if isinstance(exclude, str) else set(exclude or ())
    if not (want or avoid):
        raise OperationError("include or exclude is needed")
    names = sorted(f.name for f in df.schema.fields if (not want or family(f.dataType) in want) and family(f.dataType) not in avoid)
    if not names:
        raise OperationError("no column of these types")
    return df.select(*[col(c) for c in names])


#: Lookup values in one pass.
LOOKUPS = 50


def asof(df: DataFrame, where: object, on: str, subset: Sequence[str] | str | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """For each lookup value, in the order given, the last row at or before it without NULLs in ``subset`` (all columns by default).

    Columns: ``lookup``, then the row's; all NULL where no row qualifies. All
    lookups of a batch share one pass, each a running maximum; nothing is sorted
    or joined.
    """
    values = list(where) if isinstance(where, (list, tuple)) else [where]
    names = [subset] if isinstance(subset, str) else list(subset or df.columns)
    kind = field(df, on).dataType
    whole = F.struct(*[col(c) for c in df.columns])
    full = col(on).isNotNull()
    for c in names:
        full = full & col(c).isNotNull()
    out = None
    for a in range(0, len(values), LOOKUPS):
        part = values[a : a + LOOKUPS]
        look = [F.lit(v).cast(kind) for v in part]
        order = F.struct(col(on), *[col(c) for c in tiebreak])
        one = df.agg(*[F.max_by(whole, F.when(full & (col(on) <= v), order)).alias(f"r{i}") for i, v in enumerate(look)])
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(a + i).alias("__i"), v.alias("lookup"), F.col(f"r{i}").alias("r")) for i, v in enumerate(look)])).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise OperationError("no lookup value")
    return out.orderBy("__i").select("lookup", *[F.col("r")[c].alias(c) for c in df.columns])


def _slice(text: str) -> slice:
    try:
        return slice(*[int(p) if p.strip() else None for p in text.split(":")])
    except ValueError:
        raise OperationError(f"no slice: {text!r}") from None


def iloc_columns(df: DataFrame, indexer: object) -> list[str]:
    """Column names for a place, places, names, a mask or a slice."""
    names = df.columns
    if indexer is None:
        return names
    if isinstance(indexer, str) and ":" in indexer:
        indexer = _slice(indexer)
    if isinstance(indexer, slice):
        return names[indexer]
    if isinstance(indexer, (int, str)):
        indexer = [indexer]
    if indexer and all(isinstance(x, bool) for x in indexer):
        if len(indexer) != len(names):
            raise OperationError("the mask must have one entry for each column")
        return [c for c, keep in zip(names, indexer) if keep]
    try:
        return [names[x] if isinstance(x, int) else names[names.index(x)] for x in indexer]
    except (IndexError, ValueError):
        raise OperationError(f"no such column in {indexer!r}") from None


def iloc(df: DataFrame, row_indexer: object = None, col_indexer: object = None, order_by: str | Sequence[str] = "__pos", dense: bool = True, index_column: str | None = None) -> DataFrame:
    """Rows by place: a place (from the end if negative), places, a slice, ``"1:4"``, a mask, an SQL condition, or labels of ``index_column``.

    Places in a list keep their order and repeats. An empty list selects no
    rows; a place outside the table is an error.
    """
    if isinstance(row_indexer, tuple):
        row_indexer, col_indexer = row_indexer
    names = iloc_columns(df, col_indexer)
    if isinstance(row_indexer, str) and not all(p.strip().lstrip("-").isdigit() or not p.strip() for p in row_indexer.split(":")):
        return df.where(F.expr(row_indexer)).select(*[col(c) for c in names])
    if isinstance(row_indexer, list) and row_indexer and all(isinstance(x, str) for x in row_indexer):
        if index_column is None:
            raise OperationError("labels need an index column")
        return df.where(col(index_column).isin(row_indexer)).select(*[col(c) for c in names])
    placed = df.withColumn("__at", col(order_by)) if dense else index(df, order_by, "__at")
    if row_indexer is None:
        return placed.orderBy("__at").select(*[col(c) for c in names])
    if isinstance(row_indexer, str):
        row_indexer = _slice(row_indexer) if ":" in row_indexer else int(row_indexer)
    if isinstance(row_indexer, slice) and (row_indexer.step in (None, 1)) and all(x is None or x >= 0 for x in (row_indexer.start, row_indexer.stop)):
        rows = placed.where(F.col("__at") >= (row_indexer.start or 0))
        rows = rows if row_indexer.stop is None else rows.where(F.col("__at") < row_indexer.stop)
        return rows.orderBy("__at").select(*[col(c) for c in names])
    n = df.count()
    if isinstance(row_indexer, slice):
        start, stop, step = row_indexer.indices(n)
        if step > 0:
            rows = placed.where((F.col("__at") >= start) & (F.col("__at") < stop) & ((F.col("__at") - start) % step == 0))
            return rows.orderBy("__at").select(*[col(c) for c in names])
        rows = placed.where((F.col("__at") <= start) & (F.col("__at") > stop) & ((start - F.col("__at")) % -step == 0))
        return rows.orderBy(F.desc("__at")).select(*[col(c) for c in names])
    places = [row_indexer] if isinstance(row_indexer, int) and not isinstance(row_indexer, bool) else list(row_indexer)
    if places and all(isinstance(x, bool) for x in places):
        if len(places) != n:
            raise OperationError("the mask must have one entry for each row")
        places = [i for i, keep in enumerate(places) if keep]
    if any(not -n <= p < n for p in places):
        raise OperationError(f"place out of range of {n} rows")
    # The list comes from the caller's own memory, so it fits a broadcast.
    wanted = df.sparkSession.createDataFrame([(p % n if n else 0, i) for i, p in enumerate(places)], "__p bigint, __o int")
    return placed.join(F.broadcast(wanted), F.col("__at") == F.col("__p")).orderBy("__o").select(*[col(c) for c in names])
