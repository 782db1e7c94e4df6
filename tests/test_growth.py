"""Steps of search and of lexemes whose work may not grow with queries times documents, or with the readers of a result."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from postwright.functions import text
from postwright.operators import retrieval


def _tables(spark, seed, docs=240, queries=40, scopes=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    pick = lambda most: rnd.sample(words, min(len(words), 1 + int(rnd.expovariate(1 / most))))
    d = [(i, i % scopes if i % 17 else None, pick(6) if i % 29 else []) for i in range(docs)]
    q = [(f"q{i}", i % (scopes + 1), pick(4) + (["unseen"] if i % 5 == 0 else []) if i % 11 else []) for i in range(queries)]
    return d, q


def _expected(d, q, n, k1=1.2, b=0.75):
    out = {}
    for qid, scope, asked in q:
        mine = [(i, lex) for i, s, lex in d if s is not None and s == scope]
        avg = sum(len(x) for _, x in mine) / len(mine) if mine else 0
        df = {w: sum(w in x for _, x in mine) for w in asked}
        scored = []
        for i, lex in mine:
            s = sum(math.log(1 + (len(mine) - df[w] + 0.5) / (df[w] + 0.5)) * (k1 + 1) / (1 + k1 * (1 - b + b * len(lex) / avg)) for w in asked if w in lex)
            if s > 0:
                scored.append((-round(s, 9), i))
        for rank, (_, i) in enumerate(sorted(scored)[:n], 1):
            out[qid, rank] = i
    return out


def test_any_term_over_several_blocks_and_parts_equals_brute_force(spark, monkeypatch):
    d, q = _tables(spark, 5)
    docs = spark.createDataFrame(d, "interaction_id long, customer_id long, lexemes array<string>")
    asked = spark.createDataFrame(q, "query_id string, customer_id long, lexemes array<string>")
    want = _expected(d, q, 7)
    assert want
    for postings, terms in ((1_000_000, 1_000_000), (60, 20)):
        monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", postings)
        monkeypatch.setattr(retrieval, "PART_TERMS", terms)
        got = retrieval.keyword_search(asked, docs, match="any", n=7).collect()
        assert {(r.query_id, r.rank): r.interaction_id for r in got} == want and len(got) == len(want)


def test_any_term_makes_no_row_of_a_hit(spark):
    terms = spark.range(60).selectExpr("id AS query_id", "0 AS customer_id", "'x' AS lex", "1.0D AS idf")
    postings = spark.range(400).selectExpr("id AS interaction_id", "0 AS customer_id", "3 AS len", "'x' AS lex")
    stats = spark.createDataFrame([(0, 3.0)], "customer_id int, avg_len double")
    made = retrieval._any_of_the_terms(terms, postings, stats, 10, 1.2, 0.75)
    assert made.count() == 60 * 10  # 24,000 pairs share the word, all with one score
    assert {r.interaction_id for r in made.select("interaction_id").distinct().collect()} == set(range(10))


def test_any_term_splits_documents_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def split(x):
        calls.add(1)
        return x.split()

    docs = spark.range(50).select(F.col("id").alias("interaction_id"), F.lit(1).alias("customer_id"), F.udf(split, "array<string>")(F.concat(F.lit("a b c"), F.col("id").cast("string"))).alias("lexemes"))
    asked = spark.createDataFrame([(1, 1, ["a", "c7"])], "query_id long, customer_id int, lexemes array<string>")
    assert [r.interaction_id for r in retrieval.keyword_search(asked, docs, match="any", n=2).orderBy("rank").collect()] == [7, 0]
    assert calls.value == 50


def test_vectors_of_a_block_are_not_sorted_whole():
    rnd = np.random.default_rng(2)
    q, d = rnd.normal(size=(3000, 4)), rnd.normal(size=(4000, 4)).round(1)  # repeated vectors give equal cosines
    d[7] = d[3000]
    queries = pd.DataFrame({"query_id": range(3000), "qv": list(q)})
    docs = pd.DataFrame({"interaction_id": range(4000), "dv": list(d)}).sample(frac=1, random_state=1)
    tracemalloc.start()
    made = retrieval._best_of_block(5, True)(None, queries, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # the whole product has 96 MB
    score = np.round(q @ d.T, 9)
    score[np.arange(3000), np.arange(3000)] = -np.inf
    assert made["interaction_id"].tolist() == np.argsort(-score, axis=1, kind="stable")[:, :5].ravel().tolist()


def test_lexemes_are_read_from_a_table(spark):
    df = spark.createDataFrame([(1, "Running runs the runner"), (2, None), (None, "lost words")], "id long, body string")
    made = text.with_lexemes(df, "id", "body")
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id or 0, r.lexemes) for r in made.collect()) == [(0, []), (1, ["run", "runner"]), (2, [])]


def test_pairs_of_near_copies_shuffle_their_own_texts_alone(spark, monkeypatch):
    from postwright.llm import neardup

    met = []
    whole = neardup.join_salted
    monkeypatch.setattr(neardup, "join_salted", lambda left, right, on, *a, **k: (met.append(right.count()) if on == ["a"] else None) or whole(left, right, on, *a, **k))
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = []
    for g in range(12):  # a text and two copies with words changed
        base = [word() for _ in range(80)]
        for i in range(3):
            rows.append((g * 10 + i, " ".join(base[:i] + ["new"] * (i > 0) + base[i + 1 :] if i else base)))
    rows += [rows[0], (500, rows[5][1].upper()), (501, None)]  # a repeated row, an exact copy, no text
    found = {(r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sizes = {g: 3 + (g == 0) + (g == 1) for g in range(12)}
    assert found == {(g * 10 + i, g * 10, sizes[g]) for g in range(12) for i in range(3)} | {(500, 10, 4), (501, 501, 1)}
    assert len(met) == 2 and met[0] == 36 and met[1] == 0


def test_near_copies_are_the_same_with_and_without_broadcasts(spark, monkeypatch):
    from postwright.llm import neardup

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, base = [], []
    for i in range(60):
        if i % 5 == 0:
            base = [word() for _ in range(60)]
        rows.append((i, " ".join(base[: i % 5] + ["new"] * (i % 5 > 0) + base[i % 5 + 1 :] if i % 5 else base)))
    docs = spark.createDataFrame([*rows, (70, None), (None, rows[0][1])], "doc_id long, text string")
    plans, whole = [], neardup.join_salted

    def seen(left, right, on, *a, **k):
        made = whole(left, right, on, *a, **k)
        plans.append((on, made._jdf.queryExecution().executedPlan().toString()))
        return made

    monkeypatch.setattr(neardup, "join_salted", seen)
    found = []
    for most in (None, -1):
        if most is not None:
            monkeypatch.setattr(neardup, "BROADCAST_NODES", most)
            monkeypatch.setattr(neardup, "BROADCAST_PAIRS", most)
        plans.clear()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            found.append(sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(docs).collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert all(("SortMergeJoin" in plan) == (most is not None) for on, plan in plans if on == ["a"])
        assert sum(on == ["bucket"] for on, _ in plans) == (3 if most is None else 4)  # places go to no shuffle if few are crowded
    assert found[0] == found[1] == sorted([(i, i // 5 * 5, 6 if i < 5 else 5) for i in range(60)] + [(70, 70, 1), (-1, 0, 6)])
