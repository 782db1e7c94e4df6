"""Intermediate tables go with the driver."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
from postwright.sources.scratch import Scratch
scratch = Scratch(spark)
first = scratch.write(spark.range(5))
assert scratch.last(first.selectExpr("id + 1 AS id")).agg({"id": "sum"}).first()[0] == 15
spark.stop()
"""


def files_in(folder):
    return [p for p in Path(folder).rglob("*") if p.is_file()]


def test_nothing_is_left_after_the_session_was_stopped(tmp_path):
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=root, check=True, timeout=120)
    assert files_in(tmp_path) == []
