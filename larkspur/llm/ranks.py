"""Global row numbers without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import stored

_LOW = (1 << 33) - 1


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> tuple[DataFrame, int]:
    """``df`` with a row number from 0 in ``order``, and the number of rows.

    Rows are range-partitioned and sorted; a row's place in its partition is the low half of
    ``monotonically_increasing_id``. The partitions are written once, so that their numbers stay the
    same, and each gets the count of those before it: one number per partition, on the driver.
    """
    spark = df.sparkSession
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_at", 33).cast("int")
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    carry = spark.createDataFrame(before, "_p int, _before long")
    out = placed.join(F.broadcast(carry), part == F.col("_p"))
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW))).drop("_at", "_p", "_before"), total
