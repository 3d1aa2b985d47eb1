"""Curation of image training data as tables on Spark."""

from tagweave.errors import CurationError, GateError
from tagweave.functions.geometry import PrepareConfig

__all__ = ["CurationError", "GateError", "PrepareConfig"]
