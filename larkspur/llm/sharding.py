"""Shards cut from a Hilbert curve over metadata.

Each document is a point: the ranks of its source and language among their distinct values and the
magnitude of its size, each on ``2**BITS`` steps. Documents are sorted by their place on the Hilbert
curve through these points and cut into runs, so that a shard covers a compact box and its files'
min/max statistics prune on every dimension at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import bounded_batches, load, stored
from larkspur.llm.ranks import ranked

BITS = 6
CELLS = 1 << BITS


def hilbert(coords: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits in each dimension (Skilling 2004)."""
    x = [np.array(c, np.int64) for c in coords]
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ turn) >> b) & 1)
    return out


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert([a.to_numpy(), b.to_numpy(), c.to_numpy()]))


def _last_border(borders: Column, value: Column) -> Column:
    return F.element_at(F.filter(borders, lambda b: b["low"] <= value), -1)


def string_cells(df: DataFrame, *columns: str) -> list[Column]:
    """The step of each value of string columns, in value order; null is on step 0.

    The distinct values of all columns are found in one pass and ranked as a distributed sort; at most
    ``CELLS`` borders for each column come to the driver.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])).alias("x")
    distinct = df.select(*columns).distinct().select(each).select("x.c", "x.v").where("v IS NOT NULL").distinct()
    place, _ = ranked(distinct, [F.col("c"), F.col("v")])
    place = stored(place, "values")
    of = {r["c"]: (r["low"], r["n"]) for r in place.groupBy("c").agg(F.min("rank").alias("low"), F.count(F.lit(1)).alias("n")).collect()}
    bounds = place.join(F.broadcast(df.sparkSession.createDataFrame([(c, *x) for c, x in of.items()], "_c int, _low long, _n long")), F.col("c") == F.col("_c"))
    cell = F.floor((F.col("rank") - F.col("_low")) * CELLS / F.col("_n")).cast("int")
    borders = sorted((r["c"], r["low"], r["cell"]) for r in bounds.groupBy("c", cell.alias("cell")).agg(F.min("v").alias("low")).collect())
    out = []
    for i, c in enumerate(columns):
        own = [F.struct(F.lit(low).alias("low"), F.lit(k).alias("cell")) for j, low, k in borders if j == i]
        if not own:
            out.append(F.lit(0))
            continue
        out.append(F.when(F.col(c).isNull(), 0).otherwise(_last_border(F.array(*own), F.col(c).cast("string"))["cell"]))
    return out


def size_cells(size: Column) -> Column:
    """Two steps for each doubling."""
    bits = F.length(F.bin(size))
    half = F.when(bits > 1, F.pmod(F.floor(size * 2 / F.pow(F.lit(2.0), bits - 1)), F.lit(2))).otherwise(0)
    return F.least(F.lit(CELLS - 1), (bits - 1) * 2 + half).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 16, whole: bool = False) -> DataFrame:
    """Each document's ``size``, ``text_crc32``, ``curve``, ``shard`` and ``slot``.

    Shards hold equal numbers of rows, at most one apart; slots are gapless from 0 within a shard.
    Ties on the curve go by the text's CRC and then by doc_id, so copies with the same metadata are
    neighbours. Null texts have size 1 and CRC 0; null metadata lies on step 0; a null doc_id sorts
    first; rows that repeat each get a slot. Only narrow columns are shuffled, never the text, of whatever length.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = [F.struct(*docs.columns).alias("_whole")] if whole else []
    narrow = docs.select(*rows, "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    source, lang = string_cells(docs, "source", "lang")
    placed = narrow.withColumn("curve", _curve(source, lang, size_cells(F.col("size")))).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("curve", "text_crc32", "doc_id", "_row")]
    out, n = ranked(placed.select(*(["_whole"] if whole else []), "doc_id", "size", "text_crc32", "curve", "_row"), order)
    shard = F.floor(F.col("rank") * shards / F.lit(max(n, 1))).cast("int")
    first = F.ceil(F.col("shard").cast("bigint") * n / F.lit(shards))
    return out.withColumn("shard", shard).withColumn("slot", (F.col("rank") - first).cast("bigint")).drop("rank", "_row")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the documents as one folder per shard (``hilbert_shard``), with ``hilbert_slot`` and ``hilbert_curve`` added.

    Whole rows go through the sort on the curve once; every file is a run of neighbouring slots, so readers
    prune by the statistics of the slots, and of the metadata that the curve keeps together.
    """
    out = hilbert_shards(docs, shards, whole=True)
    added = [F.col(c).alias(f"hilbert_{c}") for c in ("shard", "slot", "curve")]
    out.select("_whole.*", *added).sortWithinPartitions("hilbert_shard", "hilbert_slot").write.partitionBy("hilbert_shard").parquet(path)


def op3_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    out = hilbert_shards(load(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
