"""CSV files: encoding, names and types found, then one distributed read."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.expressions import col
from .detect import SAMPLE, detect, override
from .names import clean_columns
from .typed import fit_types

#: The characters that iso-8859-1 leaves to control and windows-1252 has others for, and those.
CONTROL = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0))
#: Byte-order marks of UTF-16.
MARKS = (b"\xff\xfe", b"\xfe\xff")


def _start(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, through Spark's own file systems so that any store will do; none of a folder."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise FileNotFoundError(path)
    if system.getFileStatus(where).isDirectory():
        return b""
    stream = system.open(where)
    try:
        return bytes(stream.readNBytes(2))
    finally:
        stream.close()


def survey(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether quoted fields span lines), from all lines of a file, read in parallel.

    Bytes that are no UTF-8 make it windows-1252 where any lies in the range
    that iso-8859-1 leaves to control characters, else iso-8859-1. A line with
    an odd number of quotes goes on in the next one.
    """
    if _start(spark, path) in MARKS:
        return "utf-16", True
    line = F.col("value")
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    foreign = ~F.is_valid_utf8(line)
    control = F.when(foreign, F.hex(line.cast("binary")).rlike("^(?:..)*[89]"))
    one = spark.read.text(path).agg(F.count_if(quotes % 2 == 1).alias("open"), F.count_if(foreign).alias("foreign"), F.count_if(F.coalesce(control, F.lit(False))).alias("control")).first()
    encoding = "utf-8" if not one["foreign"] else "windows-1252" if one["control"] else "iso-8859-1"
    return encoding, one["open"] > 0


def load_csv(spark: SparkSession, path: str, dtypes: Mapping[str, str] | None = None, separator: str = ",") -> DataFrame:
    """A typed frame of a CSV file with a header.

    Types come from up to 5000 rows, integers a step wider than those need, and
    are widened where later rows don't fit; ``dtypes`` fixes types, and a value
    that doesn't fit one of those is an error. Quoted fields may span lines;
    only a file that has such fields is read as a whole, others in parallel.
    """
    path = os.fspath(path)
    encoding, spans = survey(spark, path)
    raw = spark.read.csv(path, header=True, multiLine=spans, encoding="iso-8859-1" if encoding == "windows-1252" else encoding, sep=separator, inferSchema=False, escape='"')
    if encoding == "windows-1252":
        raw = raw.toDF(*[c.translate(str.maketrans(CONTROL, WINDOWS)) for c in raw.columns])
        raw = raw.select(*[F.translate(col(c), CONTROL, WINDOWS).alias(c) for c in raw.columns])
    names = clean_columns(raw.columns)
    text = raw.toDF(*names)
    fixed = {c: override(k) for c, k in (dtypes or {}).items()}
    if missing := [c for c in fixed if c not in names]:
        raise ConfigurationError(f"no columns {missing}")
    rows = text.limit(SAMPLE).collect()
    kinds = {c: fixed.get(c) or detect([r[i] for r in rows], widen=True) for i, c in enumerate(names)}
    return fit_types(text, kinds, fixed).select(*[col(c) for c in names])
