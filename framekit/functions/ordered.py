"""Order-dependent operations that no single task carries out.

Spark runs a window without PARTITION BY in one task. Here rows are dealt to
ranges of the ordering key instead, each range is windowed on its own, and the
few values that cross from range to range are worked out on one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import OperationError
from .expressions import col, field, micros

BUCKET = "__bucket"
#: Ranges for each shuffle partition, and ranges at most (they are bounds in the plan).
PER_PARTITION, MOST = 2, 1024


def _tree(key: Column, bounds: list, low: int = 0) -> Column:
    """How many bounds lie at or below the key, by binary search."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(key >= bounds[mid], _tree(key, bounds[mid + 1 :], low + mid + 1)).otherwise(_tree(key, bounds[:mid], low))


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the range of ``key`` that each row falls in; NULL keys come first.

    Bounds are approximate quantiles of the key, so ranges hold about as many
    rows each; equal keys share a range.
    """
    kind = dict(df.dtypes)[key]
    parts = min(MOST, PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    c = col(key)
    if kind == "date" or kind.startswith("timestamp"):
        c, kind = micros(c, field(df, key).dataType), "bigint"
    if kind == "string" or kind.startswith(("array", "struct", "map", "binary")):
        # Text has no quantiles: ranges come from a sorted sample of distinct values.
        found = [r[0] for r in df.select(c.alias("k")).where("k is not null").groupBy("k").agg(F.xxhash64("k").alias("h")).orderBy("h").limit(50 * parts).orderBy("k").select("k").collect()]
        bounds = found[50::50]
        literal = [F.lit(b) for b in bounds]
    else:
        shares = [i / parts for i in range(1, parts)]
        found = df.agg(F.percentile_approx(c, shares, 10000)).first()[0]
        literal = [F.lit(b) for b in sorted(set(found or []))]
    return df.withColumn(BUCKET, F.when(c.isNull(), -1).otherwise(_tree(c, literal)))


def ordering(order_by: str | Sequence[str]) -> list[str]:
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if not keys:
        raise OperationError("an order is needed")
    return keys


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out


def _carry(rows: DataFrame, groups: Sequence[str], value: Column, forward: bool) -> DataFrame:
    """(groups, bucket, carry): the value that reaches each range from the ranges before it (after it, backward)."""
    per = rows.groupBy(*[col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(BUCKET).alias("__b")).agg(value.alias("__v"))
    across = Window.partitionBy(*[f"__g{i}" for i in range(len(groups))]).orderBy(F.col("__b").asc() if forward else F.col("__b").desc())
    return per.withColumn("__carry", F.last("__v", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))).drop("__v")


def _joined(rows: DataFrame, carry: DataFrame, groups: Sequence[str]) -> DataFrame:
    on = _same([col(g) for g in groups], [F.col(f"__g{i}") for i in range(len(groups))]) & (F.col(BUCKET) == F.col("__b"))
    if not groups:
        # One row a range: bounded by MOST.
        carry = F.broadcast(carry)
    return rows.join(carry, on, "left").drop("__b", *[f"__g{i}" for i in range(len(groups))])


def fill(df: DataFrame, column: str, order_by: str | Sequence[str], target: str, forward: bool = True, groups: Sequence[str] = ()) -> DataFrame:
    """``target``: ``column`` with NULLs replaced by the last value before them (the next one, backward) in order, within groups."""
    keys = ordering(order_by)
    rows = bucketed(df, keys[0])
    # Keys compare field by field, NULLs first, in either direction.
    at = F.struct(*[col(k) for k in keys])
    known = F.when(col(column).isNotNull(), at)
    edge = F.max_by(col(column), known) if forward else F.min_by(col(column), known)
    carry = _carry(rows, groups, edge, forward)
    # Backward is forward in the opposite order: Spark works a frame that begins at the
    # current row out anew for each row, which takes the square of a range's rows.
    w = Window.partitionBy(*[col(g) for g in groups], BUCKET).orderBy(*[col(k).asc() if forward else col(k).desc() for k in keys])
    near = F.last(col(column), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _joined(rows, carry, groups).withColumn("__near", near).withColumn(target, F.coalesce("__near", "__carry")).drop("__near", "__carry", BUCKET)


def lag(df: DataFrame, column: str, order_by: str | Sequence[str], target: str) -> DataFrame:
    """``target``: the value of ``column`` one row before, in order; NULL for the first row."""
    keys = ordering(order_by)
    rows = bucketed(df, keys[0])
    at = F.struct(*[col(k) for k in keys])
    # A struct around the value keeps NULL values apart from absent rows.
    carry = _carry(rows, (), F.max_by(F.struct(col(column).alias("v")), at), True)
    w = Window.partitionBy(BUCKET).orderBy(*[col(k).asc() for k in keys])
    before = F.lag(F.struct(col(column).alias("v"))).over(w)
    joined = _joined(rows, carry, ()).withColumn("__prior", F.coalesce(before, F.col("__carry")))
    return joined.withColumn(target, F.col("__prior.v")).drop("__prior", "__carry", BUCKET)


def index(df: DataFrame, order_by: str | Sequence[str], target: str) -> DataFrame:
    """``target``: each row's place in order, from 0 and without gaps."""
    keys = ordering(order_by)
    rows = bucketed(df, keys[0])
    sizes = rows.groupBy(F.col(BUCKET).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__b", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__carry"))
    w = Window.partitionBy(BUCKET).orderBy(*[col(k).asc() for k in keys])
    return _joined(rows, offsets, ()).withColumn(target, F.col("__carry") + F.row_number().over(w) - 1).drop("__carry", BUCKET)


def shift(df: DataFrame, column: str, by: int, order_by: str | Sequence[str], target: str) -> DataFrame:
    """``target``: the value of ``column`` ``by`` rows before, in order, by meeting rows on their places.

    Rows that tie in the order follow each other by their other columns, so that
    both sides of the meeting number them alike.
    """
    if by == 1:
        return lag(df, column, order_by, target)
    keys = ordering(order_by)
    rest = [f.name for f in df.schema.fields if f.name not in keys and "map<" not in f.dataType.simpleString()]
    placed = index(df, [*keys, *rest], "__at")
    before = placed.select((F.col("__at") + by).alias("__to"), col(column).alias(target))
    return placed.join(before, F.col("__at") == F.col("__to"), "left").drop("__at", "__to")
