import datetime as dt

from pyspark.sql import functions as F

from postwright.operators import audit, evaluation, filters, quality, ranking, retrieval, routing, sampling
from postwright.sources.tables import load_fixture, upsert

T0 = dt.datetime(2024, 1, 1)


def thread_tables(spark):
    tickets = spark.createDataFrame([(1, 1, "OPEN"), (2, 1, "CLOSED"), (3, 2, "PENDING")], "id long, customer_id long, status string")
    rows = spark.createDataFrame(
        [
            (10, 1, "c1", "m10", T0), (11, 2, "c2", "m11", T0), (12, 1, "c2", "m12", T0 - dt.timedelta(days=1)), (13, 3, "c3", "m13", T0), (14, None, None, "m14", T0), (15, 3, "", "m15", T0),
        ],
        "id long, ticket_id long, conversation_id string, message_id string, created_at timestamp",
    )
    return rows, tickets


def test_threads(spark):
    rows, tickets = thread_tables(spark)
    mail = spark.createDataFrame(
        [
            ("live", "c1", None, []), ("latest is closed", "c2", None, []), ("falls to reply", "c2", "m13", []), ("second reference", None, "", ["m11", "m10"]), ("nothing", "c9", "m99", ["m98"]), ("empty", "", None, []), ("no ticket", None, "m14", []),
        ],
        "query_id string, conversation_id string, in_reply_to string, reference_message_ids array<string>",
    )
    got = {r.query_id: (r.ticket_id, r.matched_on) for r in routing.detect_thread(mail, rows, tickets).collect()}
    assert got == {"live": (1, "conversation_id"), "falls to reply": (3, "in_reply_to"), "second reference": (1, "reference_message_ids")}


def test_customer_is_found_in_any_case_and_never_twice(spark):
    customers = spark.createDataFrame([(1, "Ann@X.example"), (2, "ann@x.example")], "id long, inbox_email string")
    mail = spark.createDataFrame([("a", " ANN@x.EXAMPLE "), ("b", "bob@x.example")], "query_id string, sender_email string")
    assert sorted(map(tuple, routing.identify_customer(mail, customers).select("query_id", "customer_id").collect())) == [("a", 1), ("b", None)]
    assert routing.ambiguous_inboxes(customers).count() == 1


def test_fusion_order_and_ticket_scores(spark):
    kw = spark.createDataFrame([("q", 1, 2.0, 1), ("q", 2, 1.0, 2)], "query_id string, interaction_id long, score double, rank int")
    vec = spark.createDataFrame([("q", 3, 0.9, 1), ("q", 2, 0.5, 2)], "query_id string, interaction_id long, score double, rank int")
    got = retrieval.fuse(kw, vec).orderBy("rank").collect()
    assert [r.interaction_id for r in got] == [2, 1, 3]
    assert abs(got[0].fused - 2 / 62) < 1e-12
    rows = spark.createDataFrame([(1, 7, T0), (2, 7, T0), (3, 8, T0), (4, None, T0)], "interaction_id long, ticket_id long, created_at timestamp")
    scored = ranking.score_tickets(ranking.hits_to_tickets(retrieval.fuse(kw, vec), rows), F.lit(T0)).orderBy("ticket_rank").collect()
    by = {r.ticket_id: r for r in scored}
    assert by[7].max_score == 2.0 and by[7].matched_ids == [1, 2] and abs(by[7].final_score - (0.5 * 2 + 0.3 * 1.25 + 0.2)) < 1e-9
    assert abs(by[8].final_score - (0.8 * 0.9 + 0.2)) < 1e-9


def test_context_windows_clamp_and_merge(spark):
    rows = spark.createDataFrame([(i, 1, T0 + dt.timedelta(hours=i)) for i in range(5)], "interaction_id long, ticket_id long, created_at timestamp")
    cand = spark.createDataFrame([("q", 1, [0, 1, 4])], "query_id string, ticket_id long, matched_ids array<long>")
    assert sorted(r.idx for r in ranking.context_windows(cand, rows).collect()) == [1, 2, 3]


def test_decision_rules(spark):
    queries = spark.createDataFrame([("a",), ("none",)], "query_id string")
    ranked = spark.createDataFrame([("a", 1, 5, 0.9, "x"), ("a", 2, 6, 0.1, "y")], "query_id string, position int, ticket_id long, rerank_score double, context string")
    inputs = ranking.decision_input(ranked)
    answer = lambda attach, index: lambda c: F.struct(F.lit(attach).alias("attach"), F.lit(index).cast("int").alias("index"), F.lit(0.7).alias("confidence"))
    run = lambda a, i: {r.query_id: (r.decided_ticket_id, r.should_attach, r.confidence) for r in ranking.decide(queries, inputs, answer(a, i)).collect()}
    assert run(True, None) == {"a": (5, True, 0.7), "none": (None, False, 1.0)}
    assert run(True, 2)["a"] == (6, True, 0.7)
    assert run(True, 3)["a"] == (None, False, 0.7)
    assert run(False, 1)["a"][1] is False


def test_stability_counts_null_as_an_answer(spark):
    rows = spark.createDataFrame([("k", None, False), ("k", "t", True), ("s", "t", True)], "key string, actual_ticket_key string, correct boolean")
    got = {r.key: r for r in evaluation.stability(rows).collect()}
    assert got["k"].distinct_answers == ["t", None] and not got["k"].stable and got["k"].pass_rate == 0.5
    assert got["s"].stable


def test_feedback_without_positives_is_nan(spark):
    rows = spark.createDataFrame([(False, "accepted", 0.5, None)], "should_attach boolean, manager_decision string, confidence double, corrected_ticket_id string")
    r = evaluation.feedback_confusion(rows).first()
    assert r.tn == 1 and r.precision != r.precision and r.accuracy == 1.0


def test_changed_cases_are_rows_and_count_as_the_summary_does(spark):
    schema = "key string, actual_ticket_key string, correct boolean, difficulty string, recall3 boolean, elapsed_s double, timings_ms map<string,double>"
    rows = lambda answers: spark.createDataFrame([(f"k{i}", a, a == "x", "clear", None, 1.0, {}) for i, a in enumerate(answers)], schema)
    one, two = rows(["x", None, "y", None, "x"]), rows(["x", None, "x", "y", None])
    got = {(r.key, r.actual_ticket_key_a, r.actual_ticket_key_b) for r in evaluation.changed_cases(one, two).collect()}
    assert got == {("k2", "y", "x"), ("k3", None, "y"), ("k4", "x", None)}
    summary = evaluation.compare_ab(one, two).first()
    assert (summary.n, summary.changed, summary.clear_accuracy_a, summary.clear_accuracy_b) == (5, 3, 0.4, 0.4)


def test_new_customers_without_an_address_stay_out_of_joins(spark):
    new = [(" A ", " IN@x.example "), ("B", "new@x.example"), ("C", "NEW@x.example"), ("D", "one@x.example"), ("", "two@x.example"), (None, "three@x.example"), *[("E", a) for a in (None, "", "  ")] * 3]
    df = spark.createDataFrame(new, "name string, inbox_email string")
    made = filters.validate_customers(df, spark.createDataFrame([("In@x.example",), (None,), ("",)], "inbox_email string"))
    got = made.collect()
    assert [(r.name, r.problem) for r in sorted(got, key=lambda r: r.name or "") if r.name in ("A", "B", "C", "D")] == [("A", "exists"), ("B", "duplicate"), ("C", "duplicate"), ("D", None)]
    assert len(got) == len(new) and sum(r.problem == "missing" for r in got) == 11


def test_query_rules(spark):
    texts = ["ok", "this is about claims today", "see tkt_12_3 for more words", "as an ai I cannot do it", "a plain message about money"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[x.check for x in r.f] for r in df.select(quality.query_findings(F.col("t")).alias("f")).collect()]
    assert got == [["non_degenerate"], ["label_leakage"], ["label_leakage"], ["broke_character"], []]


def test_style_buckets(spark):
    df = spark.createDataFrame([("word " * 41 + ".",), ("pls send asap.",), ("one two three " * 6,), ("see CLM-100 now.",)], "t string")
    got = [tuple(r) for r in df.select(quality.length_bucket(F.col("t")), quality.noise_level(F.col("t"))).collect()]
    assert got == [("medium", "clean"), ("short", "mild"), ("short", "heavy"), ("short", "clean")]


def test_upsert_is_repeatable(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = upsert(old, new)
    assert sorted(map(tuple, upsert(once, new).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_fixture_threads(spark):
    c = spark.createDataFrame([("c", "Clinic", "in@clinic.example")], "key string, name string, inbox_email string")
    t = spark.createDataFrame([("T1", "c", "claims", "s", "OPEN", 2.0, None)], "key string, customer string, category string, subject string, status string, age_days double, closed_age_days double")
    m = "array<struct<sender:string,type:string,offset_hours:double,content:string,sender_email_override:string>>"
    threads = spark.createDataFrame([("T1", [("customer", None, 0.0, "hi", None), ("agent", "internal_note", 1.0, "n", None), ("agent", None, 2.5, "re", None)])], f"ticket_key string, messages {m}")
    rows = load_fixture(c, t, threads, "6ba7b810-9dad-11d1-80b4-00c04fd430c8", dt.datetime(2024, 3, 1, 12))["interactions"].orderBy("created_at").collect()
    assert [r.message_id for r in rows] == ["<t1-msg01@clinic.example>", "<t1-msg02@support.example>", "<t1-msg03@support.example>"]
    assert rows[1].reference_message_ids == [] and rows[1].in_reply_to is None
    assert rows[2].in_reply_to == rows[0].message_id and rows[2].created_at == dt.datetime(2024, 2, 28, 11, 30)


def test_draws_depend_on_the_seed_alone(spark):
    df = spark.range(2000).withColumn("v", sampling.weighted_value("id", "d", {"a": 0.7, "b": 0.3}))
    n = df.filter("v = 'a'").count()
    assert 1300 < n < 1500 and n == df.repartition(7).filter("v = 'a'").count()


def test_ranks_and_weight_sums(spark):
    hits = spark.createDataFrame([("q", 5, 2.0), ("q", 6, 3.0), ("r", 5, 1.0)], "query_id string, interaction_id long, score double")
    top = retrieval.top_n(hits, ["query_id"], [F.desc("score"), "interaction_id"], 1)
    assert sorted((r.query_id, r.interaction_id, r["rank"]) for r in top.collect()) == [("q", 6, 1), ("r", 5, 1)]
    targets = spark.createDataFrame([("category", "a", 0.6), ("category", "b", 0.4), ("tier", "x", 0.5)], "dimension string, value string, target double")
    assert {r.dimension: r.ok for r in audit.weights_sum_to_one(targets).collect()} == {"category": True, "tier": False}


def test_quantiles_are_exact_in_few_rounds(spark, monkeypatch):
    import random

    import numpy as np

    from postwright.operators import ordering

    monkeypatch.setattr(ordering, "FEW", 20)
    monkeypatch.setattr(ordering, "BUCKETS", 8)
    rnd = random.Random(3)
    groups = {"normal": [rnd.gauss(0, 1) for _ in range(700)], "equal": [2.5] * 300, "skew": [float(int(rnd.paretovariate(0.4))) for _ in range(500)], "two": [1.0, 2.0], None: [5.0, -1.0, 5.0], "wide": [-1.7e308, 1.7e308, 0.0] * 20}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("equal", None), ("two", float("nan"))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k0 string, v double").repartition(4)
    got = {r.k0: (r.n, r.q0, r.q1, r.q2, r.q3) for r in ordering.quantiles(df, "v", [0.0, 0.5, 0.95, 1.0], ["k0"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs)
        if g != "wide":
            assert np.allclose(got[g][1:], np.quantile(vs, [0.0, 0.5, 0.95, 1.0]), rtol=1e-12, atol=0)
    assert got["wide"][1:3] == (-1.7e308, 0.0)
    one = ordering.quantiles(df.filter("k0 = 'normal'"), "v", [0.25]).first()
    assert abs(one.q0 - np.quantile(groups["normal"], 0.25)) < 1e-12 and one.n == 700
    assert ordering.quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_ranks_and_pages_over_ranges(spark):
    import random

    from postwright.operators import ordering

    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 1, 1, 1, 2, rnd.randrange(50)])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(6)
    order = [F.desc_nulls_last("v"), F.asc("id")]
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    ranked = {r["rank"]: r.id for r in ordering.global_rank(df, order, ranges=7).collect()}
    assert [ranked[i] for i in range(1, 901)] == want
    for offset, limit in ((0, 10), (445, 100), (890, 50), (900, 5), (2000, 5)):
        assert [r.id for r in ordering.page(df, order, limit, offset, ranges=7, most_rows=20).collect()] == want[offset : offset + limit]
    deep = ordering.page(df, order, 10, 600, ranges=7, most_rows=20)
    assert "SinglePartition" not in deep._jdf.queryExecution().executedPlan().toString() or "TakeOrdered" in deep._jdf.queryExecution().executedPlan().toString()
    assert ordering.global_rank(df.limit(0), order).count() == 0


def test_lookalike_groups_against_union_find(spark):
    import random

    from postwright.operators import audit
    from postwright.operators.components import components
    from postwright.sources.scratch import Scratch

    rnd = random.Random(6)
    edges = [(0, i) for i in range(1, 3000)] + [(10_000 + i, 10_001 + i) for i in range(90)] + [(rnd.randrange(20_000, 20_400), rnd.randrange(20_000, 20_400)) for _ in range(190)] + [(5, 5), (None, 3), (7, None), (1, 0)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in parent}
    tickets = spark.createDataFrame([(1, 1, "a", "Claim 5 of Ann denied again"), (2, 1, "a", "claim 5 of ann DENIED"), (3, 1, "a", "again claim 5 of Ann, denied"), (4, 2, "b", "claim 5 of ann denied"), (5, 2, "b", "portal"), (6, 3, "b", "Portal"), (7, 3, "b", "??"), (8, 4, "a", None)], "id long, customer_id long, category string, subject string")
    groups = {(r.category, r.group_id): (r.subjects, r.tickets, r.customers, r.kind) for r in audit.lookalike_groups(tickets).collect()}
    assert groups == {("a", 1): (2, 3, 1, "one customer, 3-way"), ("b", 5): (1, 2, 2, "several customers")}
    assert audit.lookalike_groups(tickets.limit(0)).count() == 0
