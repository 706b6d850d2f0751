"""Tools for a language-model agent, made from the operations themselves.

No provider comes with the package: ``Agent`` takes any callable that turns a
prompt and tool descriptions into calls.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from .dashboard import Dashboard
from .dataset import OPERATIONS, Dataset
from .errors import ConfigurationError, OperationError
from .functions.expressions import col, is_numeric, is_temporal

#: Distinct values that a column's profile lists at most, and rows of its preview.
LISTED, PREVIEW = 50, 5


def tools() -> list[dict[str, Any]]:
    """A description of every operation: its name, what it does and its parameters."""
    out = []
    for name in OPERATIONS:
        method = getattr(Dataset, name)
        try:
            parameters = [p for p in inspect.signature(method).parameters if p != "self"]
        except (TypeError, ValueError):
            parameters = ["options"]
        out.append({"name": name, "description": (inspect.getdoc(method) or name).split("\n")[0], "parameters": parameters})
    return out


def profile(dataset: Dataset) -> dict[str, Any]:
    """What each column holds, in one aggregate, and a few rows: the context of a prompt."""
    df = dataset.frame
    parts = []
    for i, f in enumerate(df.schema.fields):
        parts.append(F.approx_count_distinct(col(f.name)).alias(f"d{i}"))
        if is_numeric(f.dataType) or is_temporal(f.dataType):
            parts += [F.min(col(f.name)).alias(f"l{i}"), F.max(col(f.name)).alias(f"h{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    columns = {}
    for i, f in enumerate(df.schema.fields):
        about: dict[str, Any] = {"type": f.dataType.simpleString(), "distinct": one[f"d{i}"]}
        if is_numeric(f.dataType) or is_temporal(f.dataType):
            about |= {"min": one[f"l{i}"], "max": one[f"h{i}"]}
        elif one[f"d{i}"] <= LISTED and f.dataType.simpleString() == "string":
            about["values"] = [r[0] for r in df.select(col(f.name)).distinct().limit(LISTED).collect()]
        columns[f.name] = about
    return {"rows": one["n"], "columns": columns, "preview": [r.asDict() for r in df.limit(PREVIEW).collect()]}


@dataclass
class Step:
    """One call that a planner asks for; steps named in ``after`` come first."""

    name: str
    arguments: dict[str, Any] = field(default_factory=dict)
    after: list[int] = field(default_factory=list)


class Agent:
    """Plans calls with a given callable and carries them out on a dataset."""

    def __init__(self, dataset: Dataset, planner: Callable[[str, dict[str, Any], list[dict[str, Any]]], list[Step]] | None = None):
        self.dataset, self.planner = dataset, planner

    def run(self, steps: list[Step]) -> list[Any]:
        """Results of all steps; independent ones run side by side, dependent ones after those they need."""
        for s in steps:
            if s.name not in OPERATIONS:
                raise OperationError(f"no operation {s.name!r}")
        done: dict[int, Any] = {}
        with ThreadPoolExecutor(4) as pool:
            while len(done) < len(steps):
                ready = [i for i, s in enumerate(steps) if i not in done and all(j in done for j in s.after)]
                if not ready:
                    raise OperationError("the steps wait for each other")
                done |= dict(zip(ready, pool.map(lambda i: getattr(self.dataset, steps[i].name)(**steps[i].arguments), ready)))
        return [done[i] for i in range(len(steps))]

    def chat(self, prompt: str) -> dict[str, Any]:
        if self.planner is None:
            raise ConfigurationError("no planner is set")
        steps = self.planner(prompt, profile(self.dataset), tools())
        return {"steps": steps, "results": self.run(steps)}

    def dashboard(self, prompt: str) -> Dashboard:
        """The results of a conversation turn on one page."""
        done = self.chat(prompt)
        titles = [f"{i + 1}. {step.name}" for i, step in enumerate(done["steps"])]
        return Dashboard(prompt).collect({t: str(r) if isinstance(r, (dict, list)) else r for t, r in zip(titles, done["results"])})
