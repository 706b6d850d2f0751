"""Errors and the envelope of an operation's outcome."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class FramekitError(Exception):
    """Base of all errors raised here."""


class ConfigurationError(FramekitError):
    """A wrong argument or an impossible setting."""


class DataNotFoundError(FramekitError):
    """No dataset has that id, or none is active."""


class IngestionError(FramekitError):
    """Data could not be loaded."""


class OperationError(FramekitError):
    """An operation could not be carried out on the data."""


@dataclass
class OpResult:
    """What an operation involved, made and returned."""

    result: Any = None
    message: str = ""
    is_error: bool = False
    error_message: str | None = None
    involved_cols: list[str] = field(default_factory=list)
    generated_cols: list[str] = field(default_factory=list)

    def unwrap(self) -> Any:
        """The raw value; an error outcome raises instead."""
        if self.is_error:
            raise OperationError(self.error_message or self.message)
        return self.result
