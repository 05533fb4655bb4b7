"""Scalar and aggregate helpers for the semantics that Spark spells differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """INT / INT, truncating toward zero. A zero divisor is an error under ANSI mode."""
    return _div(a, b)


def _div(a: Column, b: Column) -> Column:
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.call_function("div", a, b).cast("int")


def trunc_avg(c: Column) -> Column:
    """AVG over INT with an INT result: the sum divided by the count, truncated. Skips NULL."""
    total, n = F.sum(c), F.count(c)
    return F.when(n > 0, _div(total, F.when(n > 0, n))).cast("int")


def count_all(c: Column) -> Column:
    """COUNT(expr) in the counting-NULLs form: one for each row whatever ``c`` holds."""
    return F.count(F.lit(1))


def is_true(predicate: Column) -> Column:
    """Only TRUE counts; NULL is false."""
    return F.coalesce(predicate, F.lit(False))


def between_bounds(key: list[Column], low: tuple | None, high: tuple | None, low_in: bool = True, high_in: bool = True) -> Column:
    """An index range over one or more key columns, compared in lexicographic order.

    ``None`` is unbounded. Rows with a NULL in the key are in no index, so not here either.
    """
    out = F.lit(True)
    for c in key:
        out = out & c.isNotNull()

    def lexical(bound: tuple, lower: bool, closed: bool) -> Column:
        inner = None
        for c, v in reversed(list(zip(key, bound))):
            strict = c > F.lit(v) if lower else c < F.lit(v)
            last = (c >= F.lit(v) if lower else c <= F.lit(v)) if closed else strict
            inner = last if inner is None else strict | ((c == F.lit(v)) & inner)
        return inner

    if low is not None:
        out = out & key[0].__ge__(F.lit(low[0])) & lexical(low, True, low_in)
    if high is not None:
        out = out & key[0].__le__(F.lit(high[0])) & lexical(high, False, high_in)
    return out
