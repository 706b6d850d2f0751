"""In-memory frames."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError
from ..functions.expressions import col
from .detect import detect, override
from .names import clean_columns
from .parquet import with_types
from .typed import fit_types

#: Values that the type of a text column is judged by.
SAMPLE = 50


def load_frame(spark: SparkSession, data: object, dtypes: Mapping[str, str] | None = None, position: str | None = None) -> DataFrame:
    """A typed Spark frame of a pandas frame (or what makes one), NaN as NULL.

    Columns of mixed types become text; text columns are typed by 50 of their
    values. ``position`` names a column of row numbers to add.
    """
    if not isinstance(data, pd.DataFrame):
        if not isinstance(data, (dict, list)):
            raise ConfigurationError("a pandas frame, a dict of columns or a list of rows is needed")
        data = pd.DataFrame(data)
    if data.shape[1] == 0:
        raise ConfigurationError("the frame has no columns")
    pdf = data.copy()
    pdf.columns = clean_columns([str(c) for c in pdf.columns])
    for c in pdf.columns:
        if pdf[c].dtype == object:
            kinds = {type(v) for v in pdf[c] if v is not None and not (isinstance(v, float) and v != v)}
            if len(kinds) > 1 and not kinds <= {int, float, bool} or kinds == {bool, int}:
                pdf[c] = [None if v is None or (isinstance(v, float) and v != v) else str(v) for v in pdf[c]]
        elif isinstance(pdf[c].dtype, pd.CategoricalDtype):
            pdf[c] = [None if v != v else str(v) for v in pdf[c].astype(object)]
    names = list(pdf.columns)
    if position:
        pdf[position] = range(len(pdf))
    df = spark.createDataFrame(pdf) if len(pdf) else spark.createDataFrame([], ", ".join(f"`{c}` {'bigint' if c == position else 'string'}" for c in pdf.columns))
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df = df.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c).cast("timestamp_ntz").alias(c) if isinstance(df.schema[c].dataType, T.TimestampType) and getattr(pdf[c].dtype, "tz", None) is None else col(c) for c in df.columns])
    fixed = {c: override(k) for c, k in (dtypes or {}).items()}
    guessed = {c: detect(list(pdf[c][:SAMPLE])) for c in names if isinstance(df.schema[c].dataType, T.StringType) and c not in fixed}
    guessed = {c: k for c, k in guessed.items() if k != "string"}
    return with_types(fit_types(df, guessed, {}) if guessed else df, dtypes)
