"""A dataset API for Spark sessions: load, inspect, select, clean, summarise and compute.

Names are imported when first used, so that executors load only what they run.
"""

from importlib import import_module

_HOME = {
    "Dataset": "dataset",
    "Engine": "engine",
    "ConfigurationError": "errors",
    "DataNotFoundError": "errors",
    "FramekitError": "errors",
    "IngestionError": "errors",
    "OpResult": "errors",
    "OperationError": "errors",
}
__all__ = list(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(f".{_HOME[name]}", __name__), name)
    raise AttributeError(name)
