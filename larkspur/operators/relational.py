"""The plan nodes as DataFrame functions. Each returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalar import between_bounds

#: A side of at most so many bytes, by the optimizer's own estimate, may be broadcast.
BROADCAST_BYTES = 64 << 20
#: A partition of at most so many estimated bytes may be hashed after a shuffle.
HASH_BYTES = 8 << 20


def seq_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every row; the columns asked for reach the parquet reader as its read schema."""
    return df.select(*columns) if columns else df


def index_scan(df: DataFrame, key: Sequence[str], low: tuple | None = None, high: tuple | None = None, low_in: bool = True, high_in: bool = True, ordered: bool = False) -> DataFrame:
    """Rows whose key lies between two bounds; NULL keys are left out, as an index leaves them out.

    The bound on the first key column is a plain comparison, so parquet's row-group statistics prune.
    """
    out = df.filter(between_bounds([F.col(k) for k in key], low, high, low_in, high_in))
    return out.orderBy(*[F.col(k).asc() for k in key]) if ordered else out


def values(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(list(rows), schema)


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is TRUE."""
    return df.filter(predicate)


def project(df: DataFrame, *exprs: Column | str) -> DataFrame:
    return df.select(*exprs)


def aggregate(df: DataFrame, by: Sequence[Column | str], *aggs: Column) -> DataFrame:
    """Hash aggregation: partial sums per task, one shuffle on the keys, final sums."""
    return df.groupBy(*by).agg(*aggs)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``, through the one JVM handle that this package uses."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return estimated_bytes(df) <= limit


def nested_loop_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join on any predicate. The right side is broadcast only if its estimated size is small;
    otherwise Spark chooses (an equality in ``on`` still gets a shuffled join, an inner join without one the
    product of partitions). A left join without one would be broadcast at any size, so it is made of the
    inner join and the rows that found nothing there."""
    if small(right):
        return left.join(F.broadcast(right), on, how)
    out = left.join(right, on, how)
    if how == "inner" or "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString():
        return out
    numbered = cut_lineage(left.withColumn("_row", F.monotonically_increasing_id()))
    name = left._jdf.queryExecution().analyzed()
    alias = name.alias() if name.nodeName() == "SubqueryAlias" else None
    rows = numbered.alias(alias) if alias else numbered
    met = cut_lineage(rows.crossJoin(right).where(on))
    alone = numbered.join(met.select(F.col("_row").alias("_met")).distinct(), F.col("_row") == F.col("_met"), "left_anti")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]
    return met.drop("_row").union(alone.drop("_row").select("*", *nothing))


def index_join(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, how: str = "inner") -> DataFrame:
    """Look each outer row's key up in the inner table; a NULL key finds nothing.

    A small inner side becomes a broadcast hash table; for a large one Spark shuffles and sorts, which spills.
    """
    inner = F.broadcast(inner) if small(inner) else inner
    return outer.join(inner, F.col(outer_key) == F.col(inner_key), how)


def hash_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join on one or more equal keys; ``null_safe`` lets NULL match NULL.

    The form is Spark's choice: a broadcast hash table for a side below its threshold, else a shuffle and sort that
    spills; AQE splits a partition that one key makes large. Only a right side whose partitions are small by the
    optimizer's estimate is asked to be hashed after the shuffle, which saves the sort.
    """
    on = None
    for a, b in keys:
        one = F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b)
        on = one if on is None else on & one
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = HASH_BYTES // 8 < estimated_bytes(right) <= parts * HASH_BYTES and estimated_bytes(right) <= estimated_bytes(left)
    return left.join(right.hint("shuffle_hash") if fits else right, on, how)


def sort(df: DataFrame, *keys: Column | str, nulls_first: bool = True) -> DataFrame:
    """Ascending order with NULLs first. Spark range-partitions and spills, so this is also the external sort."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return df.orderBy(*[c.asc_nulls_first() if nulls_first else c.asc_nulls_last() for c in cols])


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def top_k(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Sort and limit, which Spark fuses: each task keeps ``n`` rows."""
    return df.orderBy(*order).limit(n)


def window_columns(df: DataFrame, by: Sequence[str], order: Sequence[str], **columns: str) -> DataFrame:
    """Append window columns over one spec. ``columns`` maps a name to ``sum:x``, ``count:x``, ``avg:x``,
    ``min:x``, ``max:x`` or ``rank:``.

    With an order, peers share the running value (RANGE from the start to the current row). Without,
    the frame is the whole partition and every rank is 1. Without ``by`` no task gets all rows: see ``global_windows``.
    """
    if not by:
        return global_windows(df, order, **columns)
    spec = Window.partitionBy(*by)
    if order:
        spec = spec.orderBy(*[F.col(c).asc_nulls_first() for c in order])
    kinds = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}

    def build(what: str) -> Column:
        kind, _, arg = what.partition(":")
        if kind == "rank":
            return F.rank().over(spec).cast("bigint") if order else F.lit(1).cast("bigint")
        return kinds[kind](F.lit(1) if arg == "*" else F.col(arg)).over(spec)

    return df.withColumns({name: build(what) for name, what in columns.items()})


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder; under the warehouse where none is set."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def global_windows(df: DataFrame, order: Sequence[str], **columns: str) -> DataFrame:
    """Window columns over the whole table, without one task that reads all rows. ``columns`` as in ``window_columns``.

    Rows are aggregated per distinct key (peers share a value), keys are range-partitioned, each partition is
    scanned on its own, and what it amounts to, one row per partition, is carried over to the later ones. The
    partitions are checkpointed, so that both readers see the same ones. Without an order there is one
    row of aggregates for all.
    """
    values = sorted({w.partition(":")[2] for w in columns.values()} - {"", "*"})
    place = {v: i for i, v in enumerate(values)}
    parts = [F.count(F.lit(1)).alias("_n")]
    for v, i in place.items():
        parts += [F.sum(v).alias(f"_s{i}"), F.count(v).alias(f"_c{i}"), F.min(v).alias(f"_l{i}"), F.max(v).alias(f"_h{i}")]
    merge = {f"_{x}{i}": m for i in place.values() for x, m in (("s", F.sum), ("c", F.sum), ("l", F.min), ("h", F.max))} | {"_n": F.sum}

    def result(what: str, at: Callable[[str], Column]) -> Column:
        kind, _, arg = what.partition(":")
        if kind == "rank":
            return at("rank").cast("bigint")
        if arg == "*":
            return at("_n")
        i = place[arg]
        if kind == "avg":
            return at(f"_s{i}") / F.when(at(f"_c{i}") > 0, at(f"_c{i}"))
        return at({"sum": f"_s{i}", "count": f"_c{i}", "min": f"_l{i}", "max": f"_h{i}"}[kind])

    if not order:
        one = df.agg(*parts)
        one = one.select(*[result(w, lambda c: F.lit(1) if c == "rank" else F.col(c)).alias(n) for n, w in columns.items()])
        return df.crossJoin(F.broadcast(one))
    key = [F.col(c) for c in order]
    ascending = [c.asc_nulls_first() for c in key]
    sums = df.groupBy(*key).agg(*parts)
    ranged = cut_lineage(sums.repartitionByRange(*ascending).withColumn("_p", F.spark_partition_id()))
    local = Window.partitionBy("_p").orderBy(*ascending).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_p").agg(*[m(c).alias(c) for c, m in merge.items()])
    carry = totals.select(F.col("_p").alias("_q"), *[m(c).over(before).alias(f"{c}_b") for c, m in merge.items()])  # a row per partition
    runs = ranged.withColumns({f"{c}_r": m(c).over(local) for c, m in merge.items()}).join(F.broadcast(carry), F.col("_p") == F.col("_q"))

    def at(c: str) -> Column:
        if c == "rank":
            return at("_n") - F.col("_n") + 1
        here, past = F.col(f"{c}_r"), F.col(f"{c}_b")
        if merge[c] is F.sum:
            both = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
            return F.when(here.isNull() & past.isNull(), None).otherwise(both)
        return (F.least if merge[c] is F.min else F.greatest)(here, past)

    runs = runs.select(*[c.alias(f"_k{i}") for i, c in enumerate(key)], *[result(w, at).alias(n) for n, w in columns.items()])
    on = None
    for i, c in enumerate(order):
        one = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        on = one if on is None else on & one
    return df.join(runs, on).drop(*[f"_k{i}" for i in range(len(order))])


def global_running_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """A running sum over the whole table in ``order``; peers share a value."""
    return global_windows(df, order, **{name: f"sum:{value}"})
