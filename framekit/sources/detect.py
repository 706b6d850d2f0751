"""Types of text columns, from a sample of their values."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from ..errors import ConfigurationError

#: Values looked at in a column, and the share of them that must be dates.
SAMPLE, SHARE = 5000, 0.8
# What counts as NULL, as a truth value, and as the form of a date or time.
NULLS = {"", "nan", "none", "null"}
TRUTH = {"true", "false", "1", "0", "yes", "no", "y", "n", "t", "f"}
FORMS = (
    "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%d %H:%M:%S.%f%z",
    "%Y/%m/%d %H:%M:%S%z", "%d/%m/%Y %H:%M:%S%z", "%m/%d/%Y %H:%M:%S%z",
    "%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%m-%d-%Y", "%m/%d/%Y",
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y/%m/%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y%m%d",
)
INTEGER, DECIMAL = re.compile(r"^[+-]?\d+$"), re.compile(r"^[+-]?(\d+\.\d*|\.\d+|\d+)$")
# The Spark type of each spelling that an override may use.
OVERRIDES = {
    "int8": "smallint", "int16": "smallint", "uint8": "smallint", "smallint": "smallint", "int32": "int", "uint16": "int", "int": "int", "integer": "int",
    "int64": "bigint", "uint32": "bigint", "uint64": "decimal(20,0)", "bigint": "bigint", "float32": "float", "float": "float", "real": "float", "float4": "float",
    "float64": "double", "double": "double", "double precision": "double", "float8": "double", "numeric": "decimal(38,10)", "decimal": "decimal(38,10)",
    "bool": "boolean", "boolean": "boolean", "date": "date", "datetime64": "timestamp_ntz", "datetime64[ns]": "timestamp_ntz", "timestamp": "timestamp_ntz",
    "datetime64[ns, utc]": "timestamp", "timestamptz": "timestamp", "str": "string", "string": "string", "object": "string", "text": "string", "varchar": "string",
    "char": "string", "category": "string", "bytea": "binary",
}


def override(kind: str) -> str:
    """The Spark type that an override means."""
    key = kind.strip().lower()
    if key in OVERRIDES:
        return OVERRIDES[key]
    if re.fullmatch(r"(numeric|decimal)\(\d+\s*,\s*\d+\)", key):
        return key.replace("numeric", "decimal")
    raise ConfigurationError(f"unknown type {kind!r}")


def _parsed(value: str, form: str) -> datetime | None:
    try:
        return datetime.strptime(value, form)
    except ValueError:
        return None


def is_null(value: object) -> bool:
    return value is None or str(value).strip().lower() in NULLS


def detect(values: Sequence[object], widen: bool = False, date_first: bool = True) -> str:
    """The Spark type of text values: date or time, boolean, integer, float or string.

    Dates need a share of hits; the other types must fit every value. Truth
    values win over integers. ``widen`` takes integers one step wider than the
    sample needs.
    """
    known = [str(v).strip() for v in values[:SAMPLE] if not is_null(v)]
    if not known:
        return "string"
    if date_first:
        for form in FORMS:
            hits = [d for v in known if (d := _parsed(v, form)) is not None]
            if len(hits) >= SHARE * len(known):
                if any(d.tzinfo for d in hits):
                    return "timestamp"
                return "timestamp_ntz" if any((d.hour, d.minute, d.second, d.microsecond) != (0, 0, 0, 0) for d in hits) else "date"
    if all(v.lower() in TRUTH for v in known):
        return "boolean"
    if all(INTEGER.match(v) for v in known):
        most = max(abs(int(v)) for v in known)
        steps = ("smallint", "int", "bigint")
        at = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
        if most >= 1 << 63:
            return "string"
        return steps[min(2, at + widen)]
    if all(DECIMAL.match(v) for v in known):
        return "double" if widen else "float"
    return "string"


#: Wider types to try when a column doesn't fit.
WIDER = {"smallint": "int", "int": "bigint", "bigint": "string", "float": "double", "double": "string", "date": "timestamp_ntz", "timestamp_ntz": "string", "timestamp": "string", "boolean": "string"}



def spark_form(form: str) -> str:
    """A strptime form as a pattern of Spark's parser."""
    names = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "[SSSSSS][SSS]", "%z": "[XXX][XX]", "T": "'T'"}
    out, i = "", 0
    while i < len(form):
        for k, v in names.items():
            if form.startswith(k, i):
                out += v
                i += len(k)
                break
        else:
            out += form[i]
            i += 1
    return out


SPARK_FORMS = tuple(map(spark_form, FORMS))
