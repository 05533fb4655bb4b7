"""SQL text in, results out. Spark parses; this module only routes.

SELECT and VALUES go to ``spark.sql`` unchanged. INSERT, UPDATE, DELETE and the table and index
statements become catalog calls, as parquet tables can't be changed in place. Statements are
bound one after the other, so a script may create a table and then fill it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.types import fits
from larkspur.operators.dml import delete_rows, insert_rows, update_rows
from larkspur.plans.catalog import Catalog, CatalogError

#: Type spellings of the dialect that Spark's parser doesn't know.
SPELLINGS = {"BOOL": "BOOLEAN", "INT4": "INT", "FLOAT4": "FLOAT", "REAL": "FLOAT", "INTEGER": "INT"}
TYPES = {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType()}
NAME = r"[A-Za-z_]\w*"


@dataclass
class Result:
    """What one statement gave: rows, or a tag such as ``INSERT 3``."""

    tag: str
    rows: DataFrame | None = None


def split_statements(text: str) -> list[str]:
    """Cut at semicolons that stand outside quotes and comments."""
    token = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^;'\"`/-]+|.", re.S)
    out, now = [], []
    for m in token.finditer(text):
        piece = m.group()
        if piece == ";":
            out.append("".join(now))
            now = []
        elif not piece.startswith(("--", "/*")):
            now.append(piece)
    return [s.strip() for s in [*out, "".join(now)] if s.strip()]


def split_list(text: str) -> list[str]:
    """Cut at commas of the outermost level."""
    out, depth, quoted, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quoted:
            quoted = "" if c == quoted else quoted
        elif c in "'\"`":
            quoted = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def _match(pattern: str, text: str) -> re.Match | None:
    return re.fullmatch(pattern.replace(" ", r"\s+").replace("~", r"\s*"), text, re.I | re.S)


class Frontend:
    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark

    def run(self, text: str) -> list[Result]:
        return [self.one(s) for s in split_statements(text)]

    def one(self, s: str) -> Result:
        word = s.split(None, 1)[0].upper()
        if word in ("SELECT", "VALUES", "WITH", "("):
            return Result("SELECT", self.spark.sql(s))
        handler = {"INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "CREATE": self.create, "DROP": self.drop}.get(word)
        if handler is None:
            raise CatalogError(f"unsupported statement: {word}")
        return handler(s)

    def insert(self, s: str) -> Result:
        m = _match(rf"INSERT INTO (?P<t>{NAME})~(?:\((?P<c>[^()]*)\))?~(?P<q>(?:VALUES|SELECT|WITH|\().*)", s)
        if not m:
            raise CatalogError("INSERT needs a table and VALUES or a query")
        table = self.catalog.table(m["t"])
        new = self.spark.sql(m["q"])
        names = [c.strip() for c in m["c"].split(",")] if m["c"] else table.schema.names
        if len(names) != len(new.columns) or set(names) - set(table.schema.names):
            raise CatalogError("the number or the names of the columns don't fit")
        given = {f.name: f.dataType for f in table.schema}
        for n, f in zip(names, new.schema):
            if not fits(f.dataType, given[n]):
                raise CatalogError(f"{f.dataType.simpleString()} doesn't fit column {n} {given[n].simpleString()}")
        new = new.toDF(*names)
        full = new.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
        n = full.count()
        old = self.catalog.read(table.name)
        insert_rows(old, full)  # the types must be the table's own
        self.catalog.check(table.name, full, old)
        if n:
            self.catalog.append(table.name, full)
        return Result(f"INSERT {n}")

    def update(self, s: str) -> Result:
        m = _match(rf"UPDATE (?P<t>{NAME}) SET (?P<a>.*?)(?: WHERE (?P<w>.*))?", s)
        if not m:
            raise CatalogError("UPDATE needs a table and SET")
        pairs = [re.fullmatch(rf"(?:{m['t']}\s*\.\s*)?({NAME})\s*=\s*(.+)", p, re.S) for p in split_list(m["a"])]
        if not all(pairs):
            raise CatalogError("SET needs column = expression")
        where = F.expr(m["w"]) if m["w"] else F.lit(True)
        assign = {p[1]: F.expr(p[2]) for p in pairs}
        change = lambda df: update_rows(df.alias(m["t"]), assign, where)
        try:
            new = change(self.catalog.read(m["t"]))
        except (TypeError, ValueError) as e:
            raise CatalogError(str(e)) from None
        table = self.catalog.table(m["t"])
        if any(c in assign for c in [*table.not_null, *(c for k in table.keys for c in k)]):
            self.catalog.check(m["t"], new)
        n, files, keep = self.catalog.touched(m["t"], where)
        if n:
            self.catalog.rewrite(m["t"], files, keep, change)
        return Result(f"UPDATE {n}")

    def delete(self, s: str) -> Result:
        m = _match(rf"DELETE FROM (?P<t>{NAME})(?: WHERE (?P<w>.*))?", s)
        if not m:
            raise CatalogError("DELETE needs a table")
        where = F.expr(m["w"]) if m["w"] else F.lit(True)
        self.catalog.table(m["t"])
        n, files, keep = self.catalog.touched(m["t"], where)
        if n:
            self.catalog.rewrite(m["t"], files, keep, lambda df: delete_rows(df.alias(m["t"]), where))
        return Result(f"DELETE {n}")

    def create(self, s: str) -> Result:
        if m := _match(rf"CREATE TABLE (?P<i>IF NOT EXISTS )?(?P<t>{NAME})~\((?P<c>.*)\)", s):
            fields, not_null, keys = [], set(), []
            for part in split_list(m["c"]):
                if whole := _match(r"(?P<k>PRIMARY KEY|UNIQUE)~\((?P<c>[^()]*)\)", part):
                    keys.append(tuple(c.strip() for c in whole["c"].split(",")))
                    not_null |= set(keys[-1]) if whole["k"].upper().startswith("P") else set()
                    continue
                words = re.fullmatch(rf"({NAME})\s+([A-Za-z]\w*)(?:\s*\(\d+\))?((?:\s+(?:PRIMARY\s+KEY|NOT\s+NULL|UNIQUE|NULL))*)", part, re.S | re.I)
                if not words or words[1].upper() in ("CONSTRAINT", "CHECK", "FOREIGN"):
                    raise CatalogError(f"unsupported column or constraint: {part}")
                said = " ".join(words[3].upper().split())
                if "PRIMARY KEY" in said or "UNIQUE" in said:
                    keys.append((words[1],))
                if "PRIMARY KEY" in said or "NOT NULL" in said:
                    not_null.add(words[1])
                kind = SPELLINGS.get(words[2].upper(), words[2].upper())
                if kind not in TYPES:
                    raise CatalogError(f"unsupported type {words[2]}")
                fields.append(T.StructField(words[1], TYPES[kind]))
            self.catalog.create_table(m["t"], T.StructType(fields), bool(m["i"]), frozenset(not_null), tuple(keys))
            return Result(f"CREATE TABLE {m['t']}")
        if m := _match(rf"CREATE INDEX (?P<i>IF NOT EXISTS )?(?P<n>{NAME}) ON (?P<t>{NAME})~\((?P<c>[^()]*)\)", s):
            self.catalog.create_index(m["n"], m["t"], tuple(c.strip() for c in m["c"].split(",")), bool(m["i"]))
            return Result(f"CREATE INDEX {m['n']}")
        raise CatalogError("only CREATE TABLE and CREATE INDEX are supported")

    def drop(self, s: str) -> Result:
        if m := _match(rf"DROP (?P<k>TABLE|INDEX) (?P<i>IF EXISTS )?(?P<n>{NAME})", s):
            drop = self.catalog.drop_table if m["k"].upper() == "TABLE" else self.catalog.drop_index
            drop(m["n"], if_exists=bool(m["i"]))
            return Result(f"DROP {m['k'].upper()} {m['n']}")
        raise CatalogError("only DROP TABLE and DROP INDEX are supported")
