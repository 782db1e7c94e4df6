"""Intermediate tables of the operators go with the driver."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", sys.argv[1]).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from pathlib import Path
from postwright.llm import common, decontaminate
docs = spark.createDataFrame([(1, "name three primes below twenty please"), (2, None)], "doc_id long, text string")
items = spark.createDataFrame([(1, "Name three primes below twenty")], "item_id long, text string")
assert [r.doc_id for r in decontaminate.contaminated(docs, items).collect()] == [1]
assert any(p.is_file() for p in Path(sys.argv[1]).rglob("*"))
kept = common.cut(docs)
common.drop(kept)
assert not Path(kept.cut_folder.removeprefix("file:")).exists()
spark.stop()
"""


def test_nothing_is_left_after_the_session_was_stopped(tmp_path):
    root = Path(__file__).resolve().parent.parent.parent
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=root, check=True, timeout=180)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
