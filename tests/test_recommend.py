"""The way from mail to ticket against a plain statement of the rules, and its four paths."""

import datetime as dt
import json
import math
import os
import re
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postwright.functions import text
from postwright.operators import evaluation, ranking, retrieval
from postwright.plans.recommend import evaluate, rank_tickets, recommend

NOW = dt.datetime(2024, 3, 1)
BODIES = [
    (1, 1, "Claim CLM-100 for patient Ann was denied by the payer, please appeal"), (2, 1, "We sent the appeal of claim CLM-100 with the records"), (3, 2, "New provider enrollment form for doctor Bell is missing a signature"),
    (4, 2, "The enrollment form was signed and sent"), (5, 3, "Eligibility check failed for member 778, coverage ended in May"), (6, 4, "Claim CLM-200 was denied as duplicate"), (7, 5, "Portal password reset"),
]


def tables(spark):
    customers = spark.createDataFrame([(1, "Alpha Clinic", "in@alpha.example"), (2, "Beta Clinic", "in@beta.example")], "id long, name string, inbox_email string")
    tickets = spark.createDataFrame([(1, 1, "OPEN", "Denied claim"), (2, 1, "OPEN", "Enrollment"), (3, 1, "CLOSED", "Eligibility"), (4, 2, "OPEN", "Duplicate"), (5, 2, "RESOLVED", "Portal")], "id long, customer_id long, status string, subject string")
    rows = [(i, i, t, 1 if t <= 3 else 2, "customer_email" if i % 2 else "agent_reply", NOW - dt.timedelta(days=20 - 2 * i), f"m{i}", f"c{t}", b) for i, t, b in BODIES]
    df = spark.createDataFrame(rows, "id long, interaction_id long, ticket_id long, customer_id long, interaction_type string, created_at timestamp, message_id string, conversation_id string, clean_content string")
    return customers, tickets, text.with_lexemes(df, "id", "clean_content").withColumn("embedding", ranking.hashed_embedding("clean_content"))


def mail(spark, rows):
    return spark.createDataFrame(rows, "query_id string, subject string, body string, sender_email string, conversation_id string, in_reply_to string, reference_message_ids array<string>")


def test_the_four_paths(spark):
    emails = mail(spark, [
        ("reply", "Re: claim", "<p>Any news?</p>", " IN@alpha.example", "c1", None, []), ("same issue", "Claim", "claim CLM-100 for patient Ann was denied by the payer please appeal", "in@alpha.example", None, None, []),
        ("new issue", "", "zebra giraffe umbrella", "in@alpha.example", None, None, []), ("stranger", "Hi", "claim CLM-100 denied", "x@nowhere.example", "c1", "m1", ["m1"]), ("closed thread", "", "coverage ended", "in@alpha.example", "c3", None, []),
        ("lookalike", "", "new provider enrollment form for doctor Bell is missing a signature", "in@alpha.example", None, None, []),
    ])
    got = {r.query_id: (r.path, r.recommended_ticket_id, r.should_attach) for r in recommend(emails, *tables(spark), F.lit(NOW)).collect()}
    assert got == {
        "reply": ("auto_attach", 1, True), "same issue": ("ai_decision", 1, True), "new issue": ("ai_decision", None, False), "stranger": ("unknown_customer", None, False),
        "closed thread": ("ai_decision", 3, True), "lookalike": ("ai_decision", 2, True),
    }
    plain = {r.query_id: (r.path, r.recommended_ticket_id) for r in recommend(emails, *tables(spark), F.lit(NOW), rerank=False).collect()}
    assert plain["reply"] == ("auto_attach", 1) and plain["stranger"] == ("unknown_customer", None) and plain["same issue"] == ("ai_decision", 1)


def test_evaluation_from_mail_to_summary(spark):
    emails = mail(spark, [
        ("reply", "Re: claim", "Any news?", "in@alpha.example", "c1", None, []), ("same", "Claim", "claim CLM-100 for patient Ann was denied by the payer please appeal", "in@alpha.example", None, None, []),
        ("new", "", "zebra giraffe umbrella", "in@alpha.example", None, None, []), ("wrong", "", "zebra giraffe umbrella", "in@alpha.example", None, None, []), ("stranger", "Hi", "claim", "x@nowhere.example", None, None, []),
    ])
    cases = [("reply", [1], None, "thread"), ("same", [9, 1], None, "content"), ("new", None, None, None), ("wrong", [77], None, "content"), ("stranger", [5], "hard", None), ("unsent", [1], None, "thread")]
    expected = spark.createDataFrame([(k, e, d, None, c) for k, e, d, c in cases], "key string, expected_ticket_keys array<long>, difficulty string, ambiguity_type string, category string")
    rows = evaluate(recommend(emails, *tables(spark), F.lit(NOW)), expected, "r1")
    got = {r.key: (r.correct, r.recall20, r.recall3) for r in rows.collect()}
    assert got == {"reply": (True, None, None), "same": (True, True, True), "new": (True, None, None), "wrong": (False, False, False), "stranger": (False, None, None), "unsent": (False, None, None)}
    s = evaluation.eval_summary(rows).first()
    assert (s.total, s.clear_total, s.clear_correct, s.recall20_total, s.recall20_correct, s.hard_total, s.hard_correct, s.single_total) == (6, 5, 3, 2, 1, 1, 0, 1)
    assert sorted(r.key for r in evaluation.failed_clear_cases(rows).collect()) == ["unsent", "wrong"]
    assert {r.category: (r.total, r.correct) for r in evaluation.category_breakdown(rows).collect()} == {"thread": (2, 1), "content": (2, 1), "uncategorized": (1, 1)}


def test_ranked_tickets_against_the_rules(spark):
    _, _, rows = tables(spark)
    queries = [("q1", 1, "was the claim denied"), ("q2", 1, "enrollment form signed"), ("q3", 2, "claim denied"), ("q4", 2, "xyz")]
    asked = text.with_lexemes(spark.createDataFrame(queries, "query_id string, customer_id long, query_text string"), "query_id", "query_text").withColumn("embedding", ranking.hashed_embedding("query_text"))
    vectors = {r.query_id: (r.lexemes, r.embedding) for r in asked.collect()}
    docs = [r for r in rows.collect()]
    want = {}
    for q, customer, _ in queries:
        lex, vec = vectors[q]
        own = [d for d in docs if d.customer_id == customer]
        length = sum(len(d.lexemes) for d in own) / len(own)
        idf = {w: math.log(1 + (len(own) - n + 0.5) / (n + 0.5)) for w in lex for n in [sum(w in d.lexemes for d in own)]}
        hits = [(sum(idf[w] for w in lex) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(d.lexemes) / length)), d.id) for d in own if lex and all(w in d.lexemes for w in lex)]
        keyword = {i: (n, s) for n, (s, i) in enumerate(sorted(hits, key=lambda x: (-round(x[0], 9), x[1])), 1)}
        norm = math.sqrt(sum(x * x for x in vec))
        cosine = [(round(sum(a * b for a, b in zip(vec, d.embedding, strict=True)) / norm / math.sqrt(sum(x * x for x in d.embedding)), 9), d.id) for d in own] if norm else []
        vector = {i: (n, s) for n, (s, i) in enumerate(sorted(cosine, key=lambda x: (-x[0], x[1])), 1)}
        fused = sorted(set(keyword) | set(vector), key=lambda i: (-sum(1 / (60 + m[i][0]) for m in (keyword, vector) if i in m), keyword.get(i, (1e9,))[0], vector.get(i, (1e9,))[0]))
        groups = defaultdict(list)
        for i in fused:
            groups[next(d.ticket_id for d in docs if d.id == i)].append((vector[i][1] if i in vector else keyword[i][1], i))
        final = []
        for t, found in groups.items():
            s = sorted((m for m, _ in found), reverse=True)
            age = max((NOW - max(d.created_at for d in docs if d.id in [i for _, i in found])).total_seconds() / 86400, 0)
            final.append((0.5 * s[0] + 0.3 * sum(s[:3]) / len(s[:3]) + 0.2 * 0.5 ** (age / 14), t))
        want[q] = [(t, round(s, 6)) for s, t in sorted(final, reverse=True)]
    got = defaultdict(list)
    for r in rank_tickets(asked, rows, F.lit(NOW)).orderBy("query_id", "ticket_rank").collect():
        got[r.query_id].append((r.ticket_id, round(r.final_score, 6)))
    assert dict(got) == {q: w for q, w in want.items() if w}


def test_long_queries_match_documents_that_hold_all_their_words(spark):
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, 7, words), (2, 7, words[:-1]), (3, 8, words), (4, 7, words + ["more"])], "interaction_id long, customer_id long, lexemes array<string>")
    asked = spark.createDataFrame([("q", 7, words), ("none", 7, [])], "query_id string, customer_id long, lexemes array<string>")
    assert [(r.query_id, r.interaction_id) for r in retrieval.keyword_search(asked, docs).orderBy("rank").collect()] == [("q", 1), ("q", 4)]
    assert [r.interaction_id for r in retrieval.keyword_search(asked, docs, match="any").orderBy("rank").collect()] == [1, 4, 2]


def test_blocks_give_the_same_as_one_matrix(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6))
    v[50:60] = v[3]
    df = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(90)] + [(100, 0, None), (101, 0, [0.0] * 6)], "interaction_id long, customer_id int, embedding array<double>")
    q = df.filter("interaction_id % 3 = 0").withColumnRenamed("interaction_id", "query_id")
    whole, parts = (sorted(map(tuple, retrieval.vector_search(q, df, 7, True, *b).collect())) for b in ((20_000, 500), (8, 4)))
    assert whole == parts and {r[0] for r in whole} == {i for i in range(0, 90, 3)}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 90, 3):
        best = sorted((-round(float(u[i] @ u[j]), 9), j) for j in range(90) if j != i and j % 2 == i % 2)[:7]
        assert [r[1] for r in sorted(whole, key=lambda r: r[3]) if r[0] == i] == [j for _, j in best]


def test_model_seams_take_any_batch_function(spark):
    df = spark.createDataFrame([("a b", "b c"), ("x", "y")], "q string, c string")
    embed = ranking.batch_embedder(lambda texts: [[float(len(t)), 1.0] for t in texts], batch=1)
    score = ranking.pair_scorer(lambda q, c: [float(len(set(re.findall("[a-z]", a)) & set(re.findall("[a-z]", b)))) for a, b in zip(q, c, strict=True)])
    rows = df.select(embed("q").alias("v"), score("q", "c").alias("s")).collect()
    assert [(list(r.v), r.s) for r in rows] == [([3.0, 1.0], 1.0), ([1.0, 1.0], 0.0)]


def test_a_model_is_loaded_once_in_a_worker_and_sees_texts_of_alike_length(spark, tmp_path):
    loads, batches = tmp_path / "loads", tmp_path / "batches"
    loads.mkdir(), batches.mkdir()

    def load():
        (loads / uuid.uuid4().hex).write_text(str(os.getpid()))

        def model(texts, others=None):
            lengths = [len(t or "") for t in texts]
            (batches / uuid.uuid4().hex).write_text(json.dumps(lengths))
            return [float(n) for n in lengths] if others else [[float(n)] for n in lengths]

        return model

    texts = [("x" * ((i * 37) % 101), i) for i in range(400)] + [(None, 400), ("", 401)]
    df = spark.createDataFrame(texts, "t string, i int").repartition(16, "i")
    embed, score = ranking.batch_embedder(load=load, batch=10), ranking.pair_scorer(load=load, batch=10)
    rows = df.select("t", embed("t").alias("v")).collect()
    assert len(rows) == 402 and all(list(r.v) == [float(len(r.t or ""))] for r in rows)
    pids = [p.read_text() for p in loads.iterdir()]
    assert len(pids) == len(set(pids)) < 16  # sixteen tasks, one load a worker
    sizes = [json.loads(p.read_text()) for p in batches.iterdir()]
    assert all(len(x) <= 10 and x == sorted(x) for x in sizes)
    assert all(r.s == float(len(r.t or "")) for r in df.select("t", score("t", "t").alias("s")).collect())
    wrong = ranking.batch_embedder(lambda x: [])
    with pytest.raises(Exception, match="0 vectors for"):
        df.select(wrong("t")).collect()


def test_global_search_keeps_a_running_best(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 5))
    v[100:130] = v[3]
    rows = [(i, v[i].tolist()) for i in rng.permutation(300).tolist()] + [(900, None), (901, [0.0] * 5), (903, [1.0, 2.0])]
    docs = spark.createDataFrame(rows, "interaction_id long, embedding array<double>").repartition(5)
    asked = docs.filter("interaction_id % 7 = 0 OR interaction_id = 3").withColumnRenamed("interaction_id", "query_id")
    monkeypatch.setattr(retrieval, "CHUNK_DOCUMENTS", 16)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for own, chunk in ((True, 10), (False, 2000)):
        df = retrieval.vector_search_global(asked, docs, 6, own, chunk)
        got = {}
        for r in df.collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.interaction_id, r.score)
        for q in {r.query_id for r in asked.collect()} - {903, 901, 900}:
            best = sorted((-round(float(u[q] @ u[j]), 9), j) for j in range(300) if not (own and j == q))[:6]
            assert [got[q][k][0] for k in range(1, 7)] == [j for _, j in best]
        assert got.get(903) == (None if own else {1: (903, 1.0)})
        # vectors of documents don't go through a shuffle
        assert not any("dv" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    assert retrieval.vector_search_global(asked.limit(0), docs).count() == 0


def test_any_term_reads_few_postings_and_gives_the_same(spark):
    import random

    rnd = random.Random(8)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    docs = [(i, i % 3 // 2, sorted({*rnd.sample(common, 9), *rnd.sample(rare, rnd.randrange(1, 60))})) for i in range(3000)]
    asked = [(q, q % 3 // 2, sorted({*rnd.sample(common, 5), *rnd.sample(rare, 3)})) for q in range(12)] + [(99, 0, []), (98, 0, ["nowhere"]), (97, 5, ["c1"]), (96, 0, ["r1"])]
    d, q = spark.createDataFrame(docs, "interaction_id long, customer_id long, lexemes array<string>"), spark.createDataFrame(asked, "query_id long, customer_id long, lexemes array<string>")
    got = {}
    for r in retrieval.keyword_search(q, d, match="any", n=10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.interaction_id, round(r.score, 6))
    own = {c: [x for x in docs if x[1] == c] for c in (0, 1)}
    emitted = 0
    for query, c, words in asked:
        if c == 5:
            continue
        length, n = sum(len(x[2]) for x in own[c]) / len(own[c]), len(own[c])
        idf = {w: math.log(1 + (n - m + 0.5) / (m + 0.5)) for w in words for m in [sum(w in x[2] for x in own[c])] if m}
        scored = [(sum(idf[w] for w in words if w in x[2]) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(x[2]) / length)), x[0]) for x in own[c] if any(w in idf and w in x[2] for w in words)]
        emitted += sum(w in x[2] for x in own[c] for w in idf)
        best = sorted(scored, key=lambda x: (-round(x[0], 9), x[1]))[:10]
        assert got.get(query, {}) == {i: (d, round(s, 6)) for i, (s, d) in enumerate(best, 1)}
    assert 97 not in got
    lexes = q.select("query_id", "customer_id", F.explode("lexemes").alias("lex"))
    posts = d.select("customer_id", "interaction_id", F.size("lexemes").alias("len"), F.explode("lexemes").alias("lex"))
    stats = d.groupBy("customer_id").agg(F.count("*").alias("docs"), F.avg(F.size("lexemes")).alias("avg_len"))
    weighed = lexes.join(posts.groupBy("customer_id", "lex").agg(F.count("*").alias("df")), ["customer_id", "lex"]).join(stats, "customer_id")
    terms = weighed.select("query_id", "customer_id", "lex", "avg_len", F.expr("ln(1 + (docs - df + 0.5) / (df + 0.5))").alias("idf"))
    assert 10 * retrieval.impact_hits(terms, posts, 10)[1].count() < emitted
