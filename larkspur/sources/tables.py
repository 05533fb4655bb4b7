"""Parquet sources: one folder (or file) per table, and the shell's text sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; any path that Spark can read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Temp views over the named tables, so that SQL text can name them."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)


def render(df: DataFrame, limit: int = 1000) -> str:
    """An ASCII table with a row count. Shows ``limit`` rows at most and says so."""
    rows = df.limit(limit + 1).collect()
    more, rows = len(rows) > limit, rows[:limit]
    cells = [[("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(df.columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, widths)) + "|"
    count = f"first {limit} rows" if more else f"{len(rows)} row" + "s" * (len(rows) != 1)
    return "\n".join([rule, line(df.columns), rule, *map(line, cells), *([rule] if cells else []), count])
