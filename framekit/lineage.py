"""Lineage of calls on datasets, and replay of stored results."""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Call:
    """One recorded call on a dataset."""

    data_id: str
    opidx: int
    generated_table_name: str | None
    operation_type: str
    class_name: str
    method_name: str
    args: str
    kwargs: str
    created_at: str
    is_deep_cache: bool
    version: str


def signature(value: Any) -> str:
    """Arguments as JSON; frames by their shape or columns alone."""

    def simple(x: Any) -> Any:
        if isinstance(x, DataFrame):
            return {"frame": x.columns}
        if hasattr(x, "shape"):
            return {"shape": list(x.shape)}
        return str(x)

    return json.dumps(value, default=simple, sort_keys=True)


def chained(version: str, method: str, args: Any, kwargs: Any) -> str:
    """The version that a call makes of another one: a hash of all calls since the upload."""
    return hashlib.sha256(json.dumps([version, method, signature(args), signature(kwargs)]).encode()).hexdigest()[:16]


def unique() -> str:
    """A version that nothing else has, for what calls alone don't tell."""
    return uuid.uuid4().hex[:16]


class Lineage:
    """An append-only log of calls, one record each, so that sessions on one warehouse don't overwrite each other.

    Numbers of operations grow by one for each dataset, under a lock. ``store``
    writes one call, ``drop`` deletes a dataset's.
    """

    def __init__(self, load: Callable[[], list[dict]] | None = None, store: Callable[[dict], None] | None = None, drop: Callable[[str], None] | None = None):
        self._lock = threading.Lock()
        self.calls = sorted((Call(**x) for x in (load() if load else [])), key=lambda c: (c.created_at, c.data_id, c.opidx))
        self._store, self._drop = store, drop

    def record(self, data_id: str, method: str, args: Any, kwargs: Any, version: str, table: Callable[[Call], str | None] | None = None, kind: str = "method_call") -> Call:
        """Log a call; ``table`` stores its result under the call's number and gives the result's name."""
        with self._lock:
            last = max((c.opidx for c in self.calls if c.data_id == data_id), default=0)
            call = Call(data_id, last + 1, None, kind, "Dataset", method, signature(args), signature(kwargs), datetime.now(UTC).isoformat(), False, version)
            self.calls.append(call)
        if table is not None:
            call.generated_table_name = table(call)
            call.is_deep_cache = call.generated_table_name is not None
        with self._lock:
            if self._store:
                self._store(asdict(call))
        return call

    def find(self, data_id: str, method: str, args: Any, kwargs: Any, version: str) -> Call | None:
        """The newest stored result of the same call on the same version."""
        key = (data_id, method, signature(args), signature(kwargs), version)
        for c in reversed(self.calls):
            if c.is_deep_cache and c.generated_table_name and (c.data_id, c.method_name, c.args, c.kwargs, c.version) == key:
                return c
        return None

    def of(self, data_id: str) -> list[Call]:
        return [c for c in self.calls if c.data_id == data_id]

    def forget(self, data_id: str) -> list[str]:
        """Drop a dataset's calls; gives the tables they stored."""
        with self._lock:
            tables = [c.generated_table_name for c in self.calls if c.data_id == data_id and c.generated_table_name]
            self.calls = [c for c in self.calls if c.data_id != data_id]
            if self._drop:
                self._drop(data_id)
        return tables
