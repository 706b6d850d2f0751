"""Column arithmetic. Every result is a double column beside the input's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OperationError
from ..functions.expressions import as_double, col, field, operand, truncate

BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "mod": lambda a, b: F.try_mod(a, b),
    "pow": lambda a, b: F.pow(a, b),
    "atan2": lambda a, b: F.atan2(a, b),
}
ALIASES = {"sub": "subtract"}

UNARY = {
    "abs": F.abs,
    "negate": lambda c: -c,
    "round": lambda c, digits=0: F.round(c, digits),
    "ceil": lambda c: F.ceil(c).cast("double"),
    "floor": lambda c: F.floor(c).cast("double"),
    "truncate": truncate,
    "exp": F.exp,
    "log": lambda c: F.when(c > 0, F.log(c)),
    "log10": lambda c: F.when(c > 0, F.log10(c)),
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
}


def _rendered(x) -> str:
    return x if isinstance(x, str) and not re.match(r"^[+-]?[\d.]", x) else "_" + re.sub(r"[^0-9A-Za-z]", "_", str(x))


def _name(df: DataFrame, a, op: str, b=None) -> str:
    parts = [x if isinstance(x, str) and x in df.columns else _rendered(x) for x in (a, b) if x is not None]
    return f"{parts[0]}_{op}" + (f"_{parts[1]}" if len(parts) > 1 else "")


def binary(df: DataFrame, op: str, a, b, target: str | None = None) -> DataFrame:
    """``df`` with ``a op b``; at least one side must be a column."""
    op = ALIASES.get(op, op)
    if op not in BINARY:
        raise OperationError(f"unknown operation {op!r}")
    (x, x_col), (y, y_col) = operand(df, a), operand(df, b)
    if not (x_col or y_col):
        raise OperationError("one side must be a column")
    return df.withColumn(target or _name(df, a, op, b), BINARY[op](x, y))


def unary(df: DataFrame, op: str, column: str, target: str | None = None, **options) -> DataFrame:
    """``df`` with a function of one column."""
    if op not in UNARY:
        raise OperationError(f"unknown operation {op!r}")
    c = as_double(col(column), field(df, column).dataType)
    return df.withColumn(target or _name(df, column, op), UNARY[op](c, **options).cast("double"))


def weighted_sum(df: DataFrame, a, b, weight1: float = 1, weight2: float = 1, target: str | None = None) -> DataFrame:
    """The weighted average of both sides; NULL if the weights add up to 0."""
    (x, x_col), (y, y_col) = operand(df, a), operand(df, b)
    if not (x_col or y_col):
        raise OperationError("one side must be a column")
    total = float(weight1) + float(weight2)
    value = (x * float(weight1) + y * float(weight2)) / total if total else F.lit(None)
    return df.withColumn(target or _name(df, a, "wavg", b), value.cast("double"))


def percentage_change(df: DataFrame, old, new, target: str | None = None) -> DataFrame:
    """How much ``new`` lies above ``old``, in per cent of old's size; NULL where old is 0."""
    (x, x_col), (y, y_col) = operand(df, old), operand(df, new)
    if not (x_col or y_col):
        raise OperationError("one side must be a column")
    return df.withColumn(target or _name(df, new, "pctch", old), F.try_divide(y - x, F.abs(x)) * 100.0)


def normalize_range(df: DataFrame, column: str, target: str | None = None) -> DataFrame:
    """The column on a scale from its least value, 0, to its greatest, 1; NULL if they are equal."""
    c: Column = as_double(col(column), field(df, column).dataType)
    # One row of one pass, as a scalar subquery.
    ends = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("ends")).scalar()
    return df.withColumn(target or _name(df, column, "normalize_range"), F.try_divide(c - ends["lo"], ends["hi"] - ends["lo"]))
