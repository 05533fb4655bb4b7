"""Which types a column takes. Types are strict: an INT doesn't go into a FLOAT column, nor the reverse."""

from __future__ import annotations

from pyspark.sql import types as T


def fits(given: T.DataType, column: T.DataType) -> bool:
    """Equal types, an untyped NULL, and decimal or double literals in FLOAT columns, which SQL text can't write otherwise."""
    return given == column or isinstance(given, T.NullType) or (isinstance(column, T.FloatType) and isinstance(given, (T.DecimalType, T.DoubleType)))
