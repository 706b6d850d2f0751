"""Plots: Spark picks and bounds the points, the driver draws them.

Figures are plotly's where it is installed, plain specifications otherwise.
"""

from __future__ import annotations

import importlib.util
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import OperationError
from .functions.expressions import col

#: What each kind of plot may take from columns.
COLUMNS = {
    "bar": ("x", "y", "color", "text", "hover_name", "facet_row", "facet_col", "pattern_shape"),
    "bar_polar": ("r", "theta", "color", "hover_name", "pattern_shape"),
    "line": ("x", "y", "color", "line_dash", "line_group", "symbol", "text", "hover_name", "facet_row", "facet_col"),
    "pie": ("names", "values", "color", "hover_name"),
    "scatter": ("x", "y", "color", "size", "symbol", "text", "hover_name", "facet_row", "facet_col"),
    "scatter_3d": ("x", "y", "z", "color", "size", "symbol", "text", "hover_name"),
}
#: Most points that reach the driver; beyond it the caller must aggregate or sample.
MOST_POINTS = 100_000


def _wanted(df: DataFrame, kind: str, options: dict[str, Any]) -> list[str]:
    names: list[str] = []
    for key in COLUMNS[kind]:
        value = options.get(key)
        for name in [value] if isinstance(value, str) else list(value or []) if isinstance(value, (list, tuple)) else []:
            if name not in df.columns:
                raise OperationError(f"no column {name!r}")
            if name not in names:
                names.append(name)
    if not names:
        raise OperationError("a plot needs columns")
    return names


def points(df: DataFrame, kind: str, sample: int | None = None, **options: Any) -> DataFrame:
    """The columns that a plot refers to; a pie's values added up by name, a sample of rows by hash if asked for."""
    if kind not in COLUMNS:
        raise OperationError(f"unknown plot {kind!r}")
    if "data_frame" in options:
        raise OperationError("the dataset itself is the data")
    names = _wanted(df, kind, options)
    rows = df.select(*[col(c) for c in names])
    if kind == "pie" and options.get("names") and len(names) <= 2:
        value = F.sum(col(options["values"])).alias(options["values"]) if options.get("values") else F.count(F.lit(1)).alias("count")
        return rows.groupBy(col(options["names"])).agg(value).orderBy(col(options["names"]).asc_nulls_last())
    if sample is not None:
        rows = rows.orderBy(F.xxhash64(*[col(c) for c in names])).limit(sample)
    return rows


def plot(df: DataFrame, kind: str, sample: int | None = None, **options: Any) -> Any:
    """A figure of ``kind``; options are those of the drawing library."""
    rows = points(df, kind, sample, **options)
    data = rows.limit(MOST_POINTS + 1).toPandas()
    if len(data) > MOST_POINTS:
        raise OperationError(f"over {MOST_POINTS} points: aggregate first or give a sample size")
    if kind == "pie" and not options.get("values") and "count" in data:
        options = options | {"values": "count"}
    if importlib.util.find_spec("plotly"):
        import plotly.express as px

        return getattr(px, kind)(data, **options)
    return {"kind": kind, "options": options, "data": data.to_dict("list")}


def show(figure: Any, path: str | None = None) -> str:
    """A figure as HTML, written to ``path`` if one is given."""
    if hasattr(figure, "to_html"):
        html = figure.to_html(full_html=True, include_plotlyjs="cdn")
    else:
        html = "<pre>" + escape(str(figure)) + "</pre>"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(html)
    return html


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
