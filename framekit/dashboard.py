"""Dashboards: figures, tables and single numbers on one HTML page, two in a row."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass, field
from typing import Any

from .errors import OperationError
from .plots import escape, show

#: Widgets beside each other, and rows shown of a table.
PER_ROW, TABLE_ROWS = 2, 50


@dataclass
class Widget:
    """One thing on a dashboard: a figure, a table (pandas or Spark frame) or a metric."""

    title: str
    kind: str
    content: Any
    #: Columns of the row that it takes, of PER_ROW.
    width: int = 1

    def summary(self) -> str:
        if self.kind == "metric":
            return f"{self.title}: {self.content}"
        if self.kind == "table":
            return f"{self.title}: table of {', '.join(map(str, self.content.columns))}"
        return f"{self.title}: figure"

    def html(self) -> str:
        if self.kind == "metric":
            body = f"<p class='metric'>{escape(str(self.content))}</p>"
        elif self.kind == "table":
            frame = self.content.limit(TABLE_ROWS).toPandas() if hasattr(self.content, "toPandas") else self.content.head(TABLE_ROWS)
            body = frame.to_html(index=False)
        else:
            body = show(self.content)
        return f"<section style='flex:{self.width}'><h2>{escape(self.title)}</h2>{body}</section>"


@dataclass
class Dashboard:
    title: str = "Dashboard"
    widgets: list[Widget] = field(default_factory=list)

    def add(self, title: str, content: Any, kind: str | None = None, width: int = 1) -> Dashboard:
        """Add a widget; its kind is seen from its content. ``width`` is how much of a row it takes."""
        if not 1 <= width <= PER_ROW:
            raise OperationError(f"a widget is 1 to {PER_ROW} wide")
        if kind is None:
            kind = "table" if hasattr(content, "columns") else "metric" if isinstance(content, (int, float, str)) else "figure"
        if kind not in ("table", "metric", "figure"):
            raise OperationError(f"unknown widget {kind!r}")
        self.widgets.append(Widget(title, kind, content, width))
        return self

    def collect(self, results: dict[str, Any]) -> Dashboard:
        """Add each named result that can be shown."""
        for title, content in results.items():
            if content is not None:
                self.add(title, content)
        return self

    def design(self) -> list[dict[str, Any]]:
        """Where each widget stands: its row, its place in the row and its kind."""
        out = []
        for i, row in enumerate(self.rows()):
            at = 0
            for w in row:
                out.append({"title": w.title, "kind": w.kind, "row": i, "column": at} | ({"width": w.width} if w.width > 1 else {}))
                at += w.width
        return out

    def summarize(self) -> list[str]:
        return [w.summary() for w in self.widgets]

    def rows(self) -> list[list[Widget]]:
        """Widgets as they are laid out: a row ends where the next widget has no room."""
        out: list[list[Widget]] = []
        for w in self.widgets:
            if not out or sum(x.width for x in out[-1]) + w.width > PER_ROW:
                out.append([])
            out[-1].append(w)
        return out

    def render(self) -> str:
        rows = "".join("<div class='row'>" + "".join(w.html() for w in row) + "</div>" for row in self.rows())
        style = ".row{display:flex;gap:1em}section{flex:1}.metric{font-size:2em}"
        return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(self.title)}</title><style>{style}</style></head><body><h1>{escape(self.title)}</h1>{rows}</body></html>"

    def show(self) -> Any:
        """The page in a notebook, where there is one; its HTML otherwise."""
        html = self.render()
        if importlib.util.find_spec("IPython"):
            from IPython.display import HTML

            return HTML(html)
        return html

    def save(self, path: str) -> str:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.render())
        return path
