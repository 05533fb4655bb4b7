"""Tables as versioned lists of parquet files, constraints, and index metadata.

A version is a list of paths. INSERT adds a folder to it; UPDATE and DELETE put a new folder in the place of the
files that hold rows they change, and the others stay. What is new is written first and then named in the
registry, so a reader never sees a folder that is being written. Folders live under ``root``, which must be shared by the executors.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CatalogError(ValueError):
    """A table or index is missing or already there."""


@dataclass
class Table:
    name: str
    schema: T.StructType
    paths: tuple[str, ...] = ()
    version: int = 0
    not_null: frozenset[str] = frozenset()
    keys: tuple[tuple[str, ...], ...] = ()
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), {}

    def create_table(self, name: str, schema: T.StructType, if_not_exists: bool = False, not_null: frozenset[str] = frozenset(), keys: tuple[tuple[str, ...], ...] = ()) -> int:
        """1 if it was made, 0 if it was there and ``if_not_exists``."""
        if name in self.tables:
            if if_not_exists:
                return 0
            raise CatalogError(f"table {name} exists")
        if missing := (not_null | {c for k in keys for c in k}) - set(schema.names):
            raise CatalogError(f"no such column: {sorted(missing)}")
        self.tables[name] = Table(name, schema, not_null=not_null, keys=keys)
        self._view(self.tables[name])
        return 1

    def drop_table(self, name: str, if_exists: bool = False) -> int:
        if name not in self.tables:
            if if_exists:
                return 0
            raise CatalogError(f"no table {name}")
        del self.tables[name]
        self.spark.catalog.dropTempView(name)
        self._delete(f"{self.root}/{name}")
        return 1

    def create_index(self, name: str, table: str, columns: tuple[str, ...], if_not_exists: bool = False) -> int:
        """Register an index and rewrite the table ordered by its key, so that range scans prune row groups."""
        t = self.table(table)
        if name in t.indexes:
            if if_not_exists:
                return 0
            raise CatalogError(f"index {name} exists on {table}")
        if missing := set(columns) - set(t.schema.names):
            raise CatalogError(f"no such column: {sorted(missing)}")
        t.indexes[name] = columns
        if t.paths:
            self.replace(table, self.read(table))
        return 1

    def drop_index(self, name: str, table: str | None = None, if_exists: bool = False) -> int:
        for t in self.tables.values():
            if name in t.indexes and table in (None, t.name):
                del t.indexes[name]
                return 1
        if if_exists:
            return 0
        raise CatalogError(f"no index {name}")

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise CatalogError(f"no table {name}")
        return self.tables[name]

    def read(self, name: str) -> DataFrame:
        t = self.table(name)
        if not t.paths:
            return self.spark.createDataFrame([], t.schema)
        return self.spark.read.schema(t.schema).parquet(*t.paths)

    def check(self, name: str, new: DataFrame, beside: DataFrame | None = None) -> None:
        """Raise if rows break NOT NULL, or a key that they or they and the rows ``beside`` them must not repeat.
        A key with a NULL repeats nothing."""
        t = self.table(name)
        for c in sorted(t.not_null):
            if new.where(F.col(c).isNull()).limit(1).count():
                raise CatalogError(f"column {c} of {name} must not be NULL")
        for key in t.keys:
            known = new.select(*key).dropna()
            twice = known.groupBy(*key).count().where("count > 1").limit(1).count()
            if twice or beside is not None and beside.select(*key).join(known, list(key), "left_semi").limit(1).count():
                raise CatalogError(f"key ({', '.join(key)}) of {name} repeats")

    def append(self, name: str, df: DataFrame) -> None:
        """Write rows beside those that are there; nothing else is read or written."""
        self._write(name, df, self.table(name).paths)

    def replace(self, name: str, df: DataFrame) -> None:
        """Write the whole next version. The version before it stays readable."""
        self._write(name, df, ())

    def touched(self, name: str, where: Column) -> tuple[int, list[str], list[str]]:
        """How many rows a predicate holds for, the files that hold such rows, and the other files."""
        if not self.table(name).paths:
            return 0, [], []
        df = self.read(name)
        hits = {r["f"]: r["n"] for r in df.alias(name).where(where).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a file
        files = df.inputFiles()
        plain = {unquote(f).split(":", 1)[-1].lstrip("/"): f for f in files}
        changed = {plain[unquote(f).split(":", 1)[-1].lstrip("/")] for f in hits}
        return sum(hits.values()), sorted(changed), sorted(set(files) - changed)

    def rewrite(self, name: str, files: list[str], keep: list[str], change) -> None:
        """Put what ``change`` makes of the rows in ``files`` in their place."""
        t = self.table(name)
        self._write(name, change(self.spark.read.schema(t.schema).parquet(*files)), tuple(keep))

    def vacuum(self, name: str) -> int:
        """Delete the folders that the table's version doesn't name; frames over older versions can't be read any more."""
        t, jvm = self.table(name), self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else []) if not any(f"/{s.getPath().getName()}" in p for p in t.paths)]
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _write(self, name: str, df: DataFrame, beside: tuple[str, ...]) -> None:
        t = self.table(name)
        if t.indexes:
            key = next(iter(t.indexes.values()))
            df = df.repartitionByRange(*key).sortWithinPartitions(*key)
        path = f"{self.root}/{name}/v{t.version + 1}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        t.paths, t.version = (*beside, path), t.version + 1
        self._view(t)

    def _view(self, t: Table) -> None:
        self.read(t.name).createOrReplaceTempView(t.name)
