"""What the operators share: the shared folder, bounded Arrow batches, and sketches of fixed size."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of one Arrow batch between the JVM and Python.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20
#: Text bytes that a vectorised step works on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_scratch: dict[str, SparkSession] = {}


def _libc():
    """The C library, told to give freed memory back. Spark keeps Python workers for later stages, and
    an idle one should not hold what its largest batch took. Without glibc nothing changes."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: larger blocks are mapped on their own, and freed at once
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
        return libc
    except (OSError, AttributeError):
        return None


_LIBC = _libc()


def give_back() -> None:
    """Return what is free to the system."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def leanly(f):
    """A function for applyInArrow that gives back what a group took, once its result is on its way."""
    if f.__code__.co_argcount == 3:

        def both(key, left, right):
            give_back()
            return f(key, left, right)

        return both

    def one(key, table):
        give_back()
        return f(key, table)

    return one


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # on the driver alone, whose file server hands it out
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(z.filename)
    _shipped.add(app)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session; a smaller setting of the user's stays. Every operator that runs
    Python on the executors begins with this, so the package is sent along here."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        now = int(now[:-1]) if now[-1:].lower() == "b" else int(now)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; the warehouse, which is shared as well, where none is set."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder of ours under the shared one, deleted by ``release``, or at exit. What a lazy frame reads
    stays until then, as only its user knows when it is done with."""
    path = f"{shared_root(spark)}/larkspur/{what}-{uuid.uuid4().hex[:12]}"
    _scratch[path] = spark
    return path


def made(spark: SparkSession) -> set[str]:
    """The scratch folders of this session that are there now."""
    return {p for p, s in _scratch.items() if s is spark}


def release(spark: SparkSession, paths: set[str]) -> None:
    """Delete scratch folders. Frames that still read them can't be used any more, so name only your own."""
    for path in [p for p in paths if p in _scratch]:
        try:
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended; a left folder does no harm
            pass
        _scratch.pop(path, None)


@atexit.register
def _at_exit() -> None:
    for spark in set(_scratch.values()):
        if spark._sc is not None and spark._sc._jsc is not None:
            release(spark, made(spark))


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps don't recompute it, and a
    lost executor costs no more than the tasks that read it."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all but the text as one column ``_row``, so that no name of the input meets one of ours."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The columns of the input again, with ``text`` as it is now."""
    return df.select(*[(F.col("text") if text is None else text).alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns])


def table_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with null as the empty text and 64-bit offsets."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = pc.fill_null(col, "")
    return col.cast(pa.large_string())


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column, and where each text starts and ends in them."""
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def text_pieces(batch: pa.RecordBatch, name: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each piece of a batch."""
    buf, off = raw(table_of(batch, name))
    for a, b in pieces(off, most):
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
    give_back()


def row_batches(rows, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(key, bytes) rows in batches of about a quarter of ``BATCH_BYTES``: a batch for each row costs the JVM more than the row."""
    keys, packed, size = [], [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names)

    for key, raw in rows:
        keys.append(key)
        packed.append(raw)
        size += len(raw)
        if size >= BATCH_BYTES // 4 or len(keys) >= BATCH_ROWS:
            yield batch()
            keys, packed, size = [], [], 0
    if keys:
        yield batch()


def key_filter(keys: DataFrame, column: str, at_least: int = 1 << 20, at_most: int = 1 << 27) -> np.ndarray:
    """A bitmap of the hashes of a column's values: no false negatives, and at most 16 MB.

    The bits are OR-ed on the executors. Beyond the bound the bitmap fills up and lets more pass,
    so it may only stand in front of a join, never in its place.
    """
    n = keys.count()
    bits = at_least
    while bits < 32 * n and bits < at_most:
        bits *= 2
    h = F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(bits))
    words = keys.select(F.floor(h / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def filter_bit(bits: int, column: str) -> Column:
    """The bit number that ``key_filter`` uses, as a column, for tests in Python."""
    return F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(bits))


def has_bit(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    bit = bit.astype(np.uint64)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
