"""Errors raised by the curation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: So many offending rows are named in a message, which the driver has to hold.
NAMED = 100_000


class CurationError(Exception):
    """A request that cannot be carried out."""


class GateError(CurationError):
    """A whole-table check failed.

    ``rows`` holds every offending row as a DataFrame. The message names all of them up to
    ``NAMED``, as ``named`` lists them; what more there are it counts, and ``rows`` lists.
    """

    def __init__(self, message: str, rows: DataFrame, named: list[str]):
        super().__init__(message)
        self.rows = rows
        self.named = named


def gate(rows: DataFrame, message: str, label: str) -> None:
    """Raise :class:`GateError` unless ``rows`` is empty."""
    named = [str(row[label]) for row in rows.select(label).orderBy(label).take(NAMED)]
    if named:
        more = rows.count() - NAMED if len(named) == NAMED else 0
        told = [*named, f"and {more} more"] if more > 0 else named
        raise GateError(f"{message}: {', '.join(told)}", rows, named)
