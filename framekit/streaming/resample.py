"""Resampling of a stream: tumbling windows with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OperationError
from ..functions.expressions import as_double, col, field, from_micros, micros, unit_of
from ..operators.inspection import AGGREGATES

#: Units that a window can have; longer ones vary in length.
LENGTHS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days"}
#: Weeks start on Monday; the epoch was a Thursday.
STARTS = {"week": "4 days"}


def resample_stream(stream: DataFrame, time_column: str, rule: str, agg: str = "COUNT", value_column: str | None = None, late: str = "1 hour") -> DataFrame:
    """(time_column, value) of each unit of time, as rows later than ``late`` are given up.

    The same values as the batch operator's once a window is closed. Works on
    batch frames as well, where the watermark has no effect.
    """
    unit, name = unit_of(rule), agg.upper()
    if unit not in LENGTHS:
        raise OperationError(f"a stream can't be resampled by {unit}")
    if name not in AGGREGATES or name == "MEDIAN":
        raise OperationError(f"a stream can't be resampled to {agg!r}")
    if name != "COUNT" and value_column is None:
        raise OperationError(f"{agg} needs a value column")
    # Watermarks and windows want instants and count from midnight in UTC: the clock's time stands for one.
    time = F.timestamp_micros(micros(col(time_column).cast("timestamp_ntz"), T.TimestampNTZType()))
    rows = stream.withColumn("__t", time).withWatermark("__t", late)
    value = F.count(F.lit(1)) if value_column is None else AGGREGATES[name](as_double(col(value_column), field(stream, value_column).dataType))
    windows = rows.groupBy(F.window("__t", LENGTHS[unit], startTime=STARTS.get(unit, "0 seconds"))).agg(value.alias("value"))
    return windows.select(from_micros(F.unix_micros("window.start"), T.TimestampNTZType()).alias(time_column), "value")
