"""A small interactive shell: statements end with a semicolon, \\q leaves."""

from __future__ import annotations

import sys
import tempfile

from larkspur.plans.catalog import Catalog
from larkspur.plans.frontend import Frontend, split_statements
from larkspur.session import build_session
from larkspur.sources.tables import render


def loop(front: Frontend, lines, out) -> None:
    buffer = ""
    for line in lines:
        if line.strip() == "\\q":
            return
        buffer += line
        if not buffer.rstrip().endswith(";"):
            continue
        for statement in split_statements(buffer):
            try:
                result = front.one(statement)
                print(render(result.rows) if result.rows is not None else result.tag, file=out)
            except Exception as e:  # the shell goes on after any failed statement
                print(f"error: {str(e).splitlines()[0]}", file=out)
        buffer = ""


def main() -> None:
    spark = build_session()
    with tempfile.TemporaryDirectory() as folder:
        root = spark.conf.get("spark.sql.warehouse.dir", folder) if spark.sparkContext.master.startswith(("yarn", "k8s", "spark")) else folder
        loop(Frontend(Catalog(spark, root)), sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
