"""Nulls, empty tables, repeated rows, very long texts and clashing names, for each operator."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from postwright.llm import ann, common, components, decontaminate, linededup, mixing, neardup, pii, secrets, toxicity, urlfilter

BIG = (1 << 53) + 1
CLASH = ("k1", "salt", "n", "parts", "s", "e", "h", "row", "target", "token", "base")


def test_salted_join_equals_a_join(spark):
    rnd = random.Random(1)
    left = spark.createDataFrame([(rnd.choice([1, 1, 1, 1, 2, 3, None]), i) for i in range(300)], "k long, v long")
    right = spark.createDataFrame([(k, f"x{k}") for k in (1, 2, 4)] + [(1, "again")], "k long, w string")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, common.join_salted(left, right, ["k"], share=0.1).select("k", "v", "w").collect())) == want
    assert common.join_salted(left.limit(0), right, ["k"]).count() == 0


def test_components_of_a_star_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (0, 1)]
    got = {r.node: r.comp for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(200)} | {1000 + i: 1000 for i in range(61)}


def test_line_runs_leave_other_columns_alone(spark):
    run = "\n".join(f"line {i} of a paragraph that stands twice in the corpus" for i in range(8))
    rows = [(BIG, run + "\nown", float("nan"), None, 1), (None, run, 1.5, BIG, 2), (BIG + 1, "x\n" + run, None, 5, 3), (4, None, 0.5, 1, 4), (5, "", 0.5, 1, 5), (BIG, run + "\nown", float("nan"), None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, other long, k1 int")
    made = linededup.dedup_lines(df)
    assert made.columns == [*df.columns, "removed"]
    got = Counter((r.doc_id, r.text, "nan" if r.score is not None and r.score != r.score else r.score, r.other, r.k1, len(r.removed)) for r in made.collect())
    assert got == Counter([(BIG, run + "\nown", "nan", None, 1, 0)] * 2 + [(None, "", 1.5, BIG, 2, 8), (BIG + 1, "x", None, 5, 3, 8), (4, None, 0.5, 1, 4, 0), (5, "", 0.5, 1, 5, 0)])
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_long_texts_and_repeats_near_duplicates(spark):
    rnd = random.Random(2)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60_000))
    other = " ".join(long.split()[:-500] + ["x"] * 500)
    rows = [(1, long), (2, other), (2, other), (BIG, long.upper()), (None, "a b"), (None, "a b"), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "comp": F.lit(2), "salt": F.lit(3)})
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(df).collect())
    assert got == Counter({(1, 1, 4): 1, (2, 1, 4): 2, (BIG, 1, 4): 1, (None, None, 2): 2, (9, 9, 1): 1})


def test_bags_differ_where_sets_do_not(spark):
    words = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(1, words), (2, " ".join([words] * 4))], "doc_id long, text string")
    assert {r.class_id for r in neardup.near_duplicates(df, weighting="count").collect()} == {1, 2}


def test_mixing_narrows_by_quantiles(spark):
    rnd = random.Random(3)
    docs = [(i, "w " * rnd.randrange(1, 9), "a" if i % 3 else "b") for i in range(3000)] + [(None, None, None), (BIG, "", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "room": F.lit(1), "low": F.lit(1)})
    weight = F.when(F.col("doc_id") % 2 == 0, 0.05).otherwise(1.0)
    whole = {r.doc_id: r.taken for r in mixing.mix_sources(df, weight).collect()}
    parts = mixing.mix_sources(df, weight, bucket_rows=20)
    assert parts.columns == ["doc_id", "text", "source", "room", "low", "size", "source_size", "target", "taken"]
    rows = parts.collect()
    assert {r.doc_id: r.taken for r in rows} == whole
    for s in "ab":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mix_sources(df, with_text=False).count() == len(docs)


def test_spans_of_repeated_rows_under_clashing_names(spark):
    text = "token = abcdef12 mail a@b.example"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    for made, name in ((secrets.scan_secrets(df), "secrets"), (pii.scan_pii(df), "pii")):
        assert set(CLASH) <= set(made.columns)
        assert Counter((r.doc_id, len(r[name])) for r in made.collect()) == Counter({(1, 1): 2, (None, 1): 1, (2, 0): 1})
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_urls_of_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "http://com/en/x"), (1, "http://com/en/x"), (None, None)], "page_id long, url string").withColumns({c: F.lit(7) for c in CLASH})
    rules = urlfilter.rule_table(spark)
    assert Counter((r.page_id, r.verdict) for r in urlfilter.judge_urls(df, rules).collect()) == Counter({(1, "block"): 2, (None, "allow"): 1})
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0


def test_leaks_in_long_and_repeated_texts_and_empty_tables(spark):
    rnd = random.Random(4)
    item = "Which of the seven old bridges over the river Elbe in the town was built first by the masons?"
    long = " ".join(f"w{rnd.randrange(1000)}" for _ in range(50_000)) + " " + item
    df = spark.createDataFrame([(1, long), (1, long), (2, item), (3, None)], "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert Counter(r.doc_id for r in decontaminate.contaminated(df, items).collect()) == Counter({1: 1, 2: 1})
    assert decontaminate.contaminated(df.limit(0), items).count() == 0 and decontaminate.contaminated(df, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df, items).collect()[0].doc_id == 3


def test_toxicity_without_labels_or_texts(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        rows = toxicity.score_toxicity(df, marks).collect()
        assert Counter(r.doc_id for r in rows) == Counter({1: 2, None: 1}) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0


def test_an_index_that_leaves_cells_out_keeps_its_recall(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16))
    v = centres[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
    got = ann.search(df, df.filter("vec_id % 100 = 0"), share=0.1, least=100).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 100):
        s = u @ u[q]
        s[q] = -9
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 300 and hits >= 0.9 * 300
