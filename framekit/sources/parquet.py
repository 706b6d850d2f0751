"""Parquet files and folders, with overridden types."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import ConfigurationError
from ..functions.expressions import col
from .detect import override
from .names import clean_columns
from .typed import fit_types


def with_types(df: DataFrame, dtypes: Mapping[str, str] | None) -> DataFrame:
    """Columns cast as overridden; a value that doesn't fit is an error when it is read."""
    fixed = {c: override(k) for c, k in (dtypes or {}).items()}
    if missing := [c for c in fixed if c not in df.columns]:
        raise ConfigurationError(f"no columns {missing}")
    text = {c: k for c, k in fixed.items() if isinstance(df.schema[c].dataType, T.StringType)}
    if text:
        df = fit_types(df, text, text)
    return df.select(*[col(c).cast(fixed[c]).alias(c) if c in fixed and c not in text else col(c) for c in df.columns])


def load_parquet(spark: SparkSession, path: str, dtypes: Mapping[str, str] | None = None) -> DataFrame:
    path = os.fspath(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    return with_types(df.toDF(*clean_columns(df.columns)), dtypes)
