import random
import tracemalloc
from collections import Counter

import pyarrow as pa

from postwright.llm import linededup, quality


def test_gathering_ngrams_stays_small_in_a_worker():
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=2_000)) for _ in range(2_500)]
    names = ["text", "trusted", "fold"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True] * len(texts)), pa.array([0] * len(texts), pa.int32())], names)
    tracemalloc.start()
    parts = list(quality._gathered(2)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sum(b.column(1).to_numpy().sum() for b in parts) == sum(map(len, texts))
    assert most < 250, most


def test_line_runs_too_short_to_count_are_left_out_early(spark):
    long = "\n".join(f"line {i} of a paragraph that stands twice in the corpus" for i in range(7))
    docs = [(1, "hello\nthere\n" + long), (2, "hello\nthere\nown 2"), (3, "x 3\n" + long + "\ny 3\nhello\nthere")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lines, owners = linededup.repeated_lines(df, 50)
    found = Counter(r.doc_id for r in lines.join(owners, "g").collect())
    assert found == {1: 9, 3: 7}
    assert {r.doc_id: list(r.removed) for r in linededup.dedup_lines(df).collect()} == {1: [], 2: [], 3: list(range(1, 8))}
