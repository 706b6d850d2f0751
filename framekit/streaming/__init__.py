"""Streaming forms of batch operators."""

from .resample import resample_stream

__all__ = ["resample_stream"]
