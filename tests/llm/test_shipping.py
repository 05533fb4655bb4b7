"""Workers that don't have the repository on their path get it from the driver."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from larkspur.llm.queries import QUERIES
name = next(n for n in QUERIES if n.startswith(sys.argv[2] + "_"))
conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": sys.argv[3] + "/wh", "spark.checkpoint.dir": sys.argv[3] + "/ck"}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
print("rows", QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("op", ["op3", "op5", "op9"])
def test_without_the_path(tmp_path, op):
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE, root, op, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0 and "rows " in got.stdout, got.stderr[-2000:]
