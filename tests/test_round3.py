"""Findings of round 3: whole results, and no step whose work grows faster than its input."""

import random

from pyspark.sql import functions as F

from postwright.operators import audit, evaluation, quality
from postwright.sources.scratch import Scratch


def _jaccard(x, y):
    return len(x & y) / len(x | y)


def test_lookalike_members_against_brute_force(spark):
    rnd = random.Random(3)
    subjects = {}
    for i in range(160):  # short and long subjects, many of them a word or two away from another
        seed = rnd.choice([["case", "unit", "desk"], ["a", "b", "c", "d", "e"], [f"w{j}" for j in range(14)], [f"v{j}" for j in range(9)]])
        words = set(seed) | {str(rnd.randrange(6)) for _ in range(rnd.randrange(4))}
        words -= set(rnd.sample(sorted(words), rnd.randrange(3)))
        subjects[i] = ("x" if i % 3 else "y", frozenset(words))
    tickets = spark.createDataFrame([(i, i % 5, c, " ".join(sorted(w))) for i, (c, w) in subjects.items()], "id long, customer_id long, category string, subject string")
    for threshold in (0.6, 0.7, 0.8):
        parent = {i: i for i in subjects}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, (ca, wa) in subjects.items():
            for b, (cb, wb) in subjects.items():
                if a < b and ca == cb and _jaccard(wa, wb) >= threshold - 1e-9:
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
        got = {r.id: r.group_id for r in audit.lookalike_members(tickets, threshold).collect()}
        assert got == {i: find(i) for i in subjects}


def test_links_of_lookalikes_grow_with_subjects_not_pairs(spark):
    tickets = spark.range(900).selectExpr("id", "id AS customer_id", "'x' AS category", "concat('case ', id % 30, ' unit ', 100 + id div 30, ' desk 7') AS subject")
    sets = tickets.selectExpr("category", "array_sort(split(subject, ' ')) AS w", "id", "6 AS n")
    links = audit._subset_links(sets, 0.7, audit._subset_sizes([6], 0.7))
    assert links.count() <= 6 * 900  # 26,100 pairs are alike
    assert audit.lookalike_members(tickets, 0.7).select("group_id").distinct().collect() == [(0,)]


def test_eval_summary_names_the_failed_clear_cases(spark):
    rows = [("r", "b", "clear", False), ("r", "a", None, False), ("r", "b", "clear", False), ("r", "c", "hard", False), ("r", None, "clear", False), ("s", "a", "clear", True), (None, "z", "clear", False)]
    df = spark.createDataFrame(rows, "run string, key string, difficulty string, correct boolean").selectExpr("*", "CAST(NULL AS STRING) AS ambiguity_type", "true AS recall20", "true AS recall3", "1.0D AS elapsed_s")
    assert {r.run: r.failed_clear_keys for r in evaluation.eval_summary(df).collect()} == {"r": ["a", "b", "b"], "s": [], None: ["z"]}


def test_tickets_without_a_sibling_are_spread(spark):
    t = spark.range(2000).select(F.col("id").cast("string").alias("temp_id"), F.struct(F.lit("OPEN").alias("status"), F.lit("claims").alias("category"), F.lit(1).alias("created_at_offset_days"), F.lit(None).cast("int").alias("closed_at_offset_days")).alias("production_fields"), F.struct(F.lit("d").alias("distinguishing_details"), F.lit("c").alias("claim_number"), F.lit("p").alias("patient_id")).alias("generation_metadata"))
    given = t.select("temp_id", F.lit("claims").alias("category"), F.lit("OPEN").alias("status"), F.when(F.col("temp_id") == "5", "6").when(F.col("temp_id") == "9", "none").alias("disambiguation_sibling"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = quality.check_tickets(t, given)
        per_task = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        found = {r.temp_id: len(r.findings) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert len(found) == 2000 and max(per_task) < 1000
    extra = {k for k, n in found.items() if n > found["0"]}
    assert extra == {"5"}


def test_global_search_holds_little_at_once(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from postwright.operators.retrieval import _running_best

    rnd = np.random.default_rng(1)
    q, d = rnd.normal(size=(2000, 8)), rnd.normal(size=(4096, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4096)), pa.array(d.tolist())], ["i", "v"])
    run = _running_best(list(range(2000)), q.tolist(), 10, True, ["query_id", "interaction_id", "score"])
    tracemalloc.start()
    made = list(run(iter([batch])))[0].to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000
    score = np.round(q @ d.T, 9)
    score[np.arange(2000), np.arange(2000)] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :10]
    assert [sorted(x) for x in made.groupby("query_id")["interaction_id"].apply(list)] == [sorted(x) for x in best.tolist()]


def test_keyword_list_of_the_fusion_makes_few_pairs(spark):
    from pyspark.sql import Window

    from postwright.plans import queries

    d = spark.range(3000).selectExpr("id AS interaction_id", "id % 2 AS customer_id")
    q = d.filter("interaction_id % 20 = 0").withColumnRenamed("interaction_id", "query_id")
    best = lambda pairs: {(r.query_id, r.interaction_id) for r in pairs.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.expr("(query_id + interaction_id) % 17"), "interaction_id"))).filter("n <= 50").collect()}
    few = queries.keyword_pairs(q, d)
    assert few.count() <= 150 * 17 * 51
    assert best(few) == best(q.join(d, "customer_id").filter("query_id <> interaction_id"))


def test_style_reads_a_text_a_few_times_only(spark):
    df = spark.createDataFrame([("x pls ab-1 asap",), (None,)], "t string")
    plan = df.select(quality.noise_level(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert [r.n for r in df.select(quality.noise_level(F.col("t")).alias("n")).collect()] == ["mild", "clean"]
