"""INSERT, UPDATE and DELETE as transforms of one immutable version into the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalar import is_true
from larkspur.functions.types import fits


def insert_rows(table: DataFrame, new: DataFrame) -> DataFrame:
    """A bag union by position; duplicates stay. Types must be the table's own."""
    if [f.dataType for f in table.schema] != [f.dataType for f in new.schema]:
        raise TypeError(f"rows of {new.schema.simpleString()} don't fit {table.schema.simpleString()}")
    return table.union(new.toDF(*table.columns))


def update_rows(table: DataFrame, assign: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Every right-hand side sees the old row, so columns can be swapped. Each row changes once."""
    hit = is_true(where) if where is not None else F.lit(True)
    unknown = set(assign) - set(table.columns)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    types = {f.name: f.dataType for f in table.schema}
    for name, given in zip(assign, table.select(*[e.alias(n) for n, e in assign.items()]).schema):
        if not fits(given.dataType, types[name]):
            raise TypeError(f"{given.dataType.simpleString()} doesn't fit column {name} {types[name].simpleString()}")
    return table.select(*[F.when(hit, assign[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in table.columns])


def delete_rows(table: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows whose predicate is TRUE go; NULL keeps the row."""
    return table.filter(~is_true(where)) if where is not None else table.filter(F.lit(False))
