"""Run a query and its SQL over the same parquet files and compare the rows as bags."""

import math
import pathlib

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = pathlib.Path(folder, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, folder: str, sql: str) -> None:
    names, want = sql_rows(folder, sql)
    assert sorted(df.columns) == sorted(names)
    got, want = bag(df.columns, [tuple(r) for r in df.collect()]), bag(names, want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
