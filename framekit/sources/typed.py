"""Text columns to typed ones, over all rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.expressions import NUMBER, col
from .detect import NULLS, SPARK_FORMS, WIDER


def known(c: Column) -> Column:
    """The text, or NULL where it stands for NULL."""
    return F.when(~F.lower(F.trim(c)).isin(sorted(NULLS)), F.trim(c))


def cast_text(c: Column, kind: str) -> Column:
    """Text as ``kind``; NULL where it doesn't fit."""
    t = known(c)
    if kind == "string":
        return c
    if kind == "boolean":
        low = F.lower(t)
        return F.when(low.isin("true", "yes", "t", "y", "1"), True).when(low.isin("false", "no", "f", "n", "0"), False)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        parsed = F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in SPARK_FORMS])
        return parsed.cast(kind)
    if kind in ("smallint", "int", "bigint"):
        return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast(kind))
    return F.when(t.rlike(NUMBER), t.try_cast(kind))


def fit_types(df: DataFrame, kinds: Mapping[str, str], locked: Mapping[str, str]) -> DataFrame:
    """Text columns as the given types, wider where some value doesn't fit.

    All columns are checked in one aggregate a round, over all rows. A column
    whose type the caller fixed must fit, or it is an error.
    """
    now = dict(kinds)
    open_ = [c for c, k in now.items() if k != "string"]
    while open_:
        bad = df.agg(*[F.count(F.when(known(col(c)).isNotNull() & cast_text(col(c), now[c]).isNull(), 1)).alias(f"b{i}") for i, c in enumerate(open_)]).first()
        failed = [c for i, c in enumerate(open_) if bad[i]]
        for c in failed:
            if c in locked:
                raise ConfigurationError(f"column {c!r} has {bad[open_.index(c)]} values that aren't {now[c]}")
            now[c] = WIDER.get(now[c], "string")
        open_ = [c for c in failed if now[c] != "string"]
    return df.select(*[cast_text(col(c), now[c]).alias(c) if c in now else col(c) for c in df.columns])


