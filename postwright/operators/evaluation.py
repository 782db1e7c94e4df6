"""Evaluation: correctness, roll-ups, stability, A/B comparison and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import quantiles


def is_correct(expected="expected_ticket_keys", actual="actual_ticket_key") -> Column:
    """U2. With nothing expected: nothing recommended; else one of the expected."""
    return F.when(F.col(expected).isNull(), F.col(actual).isNull()).otherwise(F.coalesce(F.array_contains(expected, F.col(actual)), F.lit(False)))


def recall(expected="expected_ticket_keys", pool="pool") -> Column:
    """U1. Whether the pool holds an expected ticket; null if nothing is expected or the stage didn't run."""
    return F.when(F.col(expected).isNotNull() & F.col(pool).isNotNull(), F.coalesce(F.arrays_overlap(expected, pool), F.lit(False)))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(float("nan")))


def feedback_confusion(feedback: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A5, A6, A7. tp, fp, tn, fn; accuracy, precision, recall, f1 (NaN where undefined); confidence by agreement,
    and calibrated, whether it is greater where the manager agreed; rejections that name another ticket."""
    yes, agreed = F.col("should_attach"), F.col("manager_decision") == "accepted"
    tp, fp, tn, fn = (F.count_if(a & b) for a, b in ((yes, agreed), (yes, ~agreed), (~yes, agreed), (~yes, ~agreed)))
    df = feedback.groupBy(*(by or [])).agg(
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        F.avg(F.when(agreed, F.col("confidence"))).alias("confidence_agreed"), F.avg(F.when(~agreed, F.col("confidence"))).alias("confidence_disagreed"),
        F.count_if(~agreed & F.col("corrected_ticket_id").isNotNull()).alias("corrected"),
    )
    c = {n: F.col(n) for n in ("tp", "fp", "tn", "fn")}
    df = df.withColumn("accuracy", ratio(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]))
    df = df.withColumn("precision", ratio(c["tp"], c["tp"] + c["fp"])).withColumn("recall", ratio(c["tp"], c["tp"] + c["fn"]))
    df = df.withColumn("f1", F.when(F.isnan("precision") | F.isnan("recall"), F.lit(float("nan"))).otherwise(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    return df.withColumn("calibrated", F.col("confidence_agreed") > F.col("confidence_disagreed")).withColumn("corrected", F.when(F.col("fn") > 0, F.col("corrected")))


def _clear() -> Column:
    return ~F.col("difficulty").eqNullSafe("hard")


def eval_summary(results: DataFrame) -> DataFrame:
    """A8. One row for each run; failed_clear_keys holds the keys of all clear cases that failed, in order, a key as often as
    it failed. failed_clear_cases() gives them as rows, with their tickets."""
    clear, hard = _clear(), F.col("difficulty").eqNullSafe("hard")
    multi = F.col("ambiguity_type").eqNullSafe("multi_acceptable")
    counts = {
        "total": F.count("*"), "clear_total": F.count_if(clear), "clear_correct": F.count_if(clear & F.col("correct")),
        "recall20_total": F.count("recall20"), "recall20_correct": F.count_if("recall20"), "recall3_total": F.count("recall3"), "recall3_correct": F.count_if("recall3"),
        "hard_total": F.count_if(hard), "hard_correct": F.count_if(hard & F.col("correct")),
        "multi_total": F.count_if(hard & multi), "multi_correct": F.count_if(hard & multi & F.col("correct")),
        "single_total": F.count_if(hard & ~multi), "single_correct": F.count_if(hard & ~multi & F.col("correct")), "elapsed_s": F.sum("elapsed_s"),
    }
    # keys are counted before a run's are gathered, so what is gathered grows with distinct keys
    failed = results.filter(clear & ~F.col("correct") & F.col("key").isNotNull()).groupBy("run", "key").agg(F.count("*").cast("int").alias("n"))
    failed = failed.groupBy(F.col("run").alias("failed__run")).agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("x"))
    failed = failed.select("failed__run", F.flatten(F.transform("x", lambda x: F.array_repeat(x["key"], x["n"]))).alias("failed_clear_keys"))
    made = results.groupBy("run").agg(*[c.alias(n) for n, c in counts.items()]).join(failed, F.col("run").eqNullSafe(F.col("failed__run")), "left").drop("failed__run")
    return made.withColumn("failed_clear_keys", F.coalesce("failed_clear_keys", F.array().cast("array<string>")))


def failed_clear_cases(results: DataFrame) -> DataFrame:
    """A8. (run, key, expected_ticket_keys, actual_ticket_key) of every clear case that isn't correct, a row each."""
    return results.filter(_clear() & ~F.col("correct")).select("run", "key", "expected_ticket_keys", "actual_ticket_key")


def category_breakdown(results: DataFrame) -> DataFrame:
    """A9. Clear cases by run and category; null is uncategorized; categories without a clear case don't appear."""
    clear = results.filter(_clear()).withColumn("category", F.coalesce("category", F.lit("uncategorized")))
    return clear.groupBy("run", "category").agg(
        F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.count("recall20").alias("recall20_total"), F.count_if("recall20").alias("recall20_correct"),
        F.count("recall3").alias("recall3_total"), F.count_if("recall3").alias("recall3_correct"), F.avg(F.when(F.col("correct"), F.col("confidence"))).alias("confidence_correct"),
    )


def eval_rollup(results: DataFrame) -> DataFrame:
    """A10. Category rows, run rows and one overall row in one pass; level is 0, 1 and 3."""
    df = results.withColumn("category", F.coalesce("category", F.lit("uncategorized")))
    return df.rollup("run", "category").agg(F.grouping_id().alias("level"), F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.count_if("recall20").alias("recall20_correct"))


def run_history(results: DataFrame) -> DataFrame:
    """A11. Runs in order of generated_at, else of their name, with latest marked."""
    runs = eval_summary(results).join(results.groupBy("run").agg(F.max("generated_at").alias("generated_at")), "run")
    at = F.coalesce("generated_at", "run")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at, "run"))
    return runs.withColumn("place", place).withColumn("latest", F.col("place") == F.count("*").over(Window.partitionBy(F.lit(0))))


def stability(attempts: DataFrame) -> DataFrame:
    """A12, A13. By key: runs, passes, pass_rate, distinct answers (null is one, sorted last), modal answer, stable."""
    answer = F.struct(F.col("actual_ticket_key").isNull().alias("none"), F.col("actual_ticket_key").alias("answer"))
    counts = attempts.groupBy("key", answer.alias("a")).agg(F.count("*").alias("n"), F.count_if("correct").alias("ok"))
    df = counts.groupBy("key").agg(
        F.sum("n").alias("run_count"), F.sum("ok").alias("pass_count"), F.array_sort(F.collect_list("a")).alias("answers"),
        F.min(F.struct((-F.col("n")).alias("m"), "a")).alias("mode"),
    )
    return df.select(
        "key", "run_count", "pass_count", (F.col("pass_count") / F.col("run_count")).alias("pass_rate"), F.transform("answers", lambda x: x.answer).alias("distinct_answers"),
        F.col("mode.a.answer").alias("modal_answer"), (F.size("answers") <= 1).alias("stable"),
    )


def combined_stability(*observations: DataFrame) -> DataFrame:
    """A13. stability() over the attempts of several sources."""
    every = observations[0]
    for o in observations[1:]:
        every = every.unionByName(o, allowMissingColumns=True)
    return stability(every)


def _ticket_differs() -> Column:
    return ~F.col("actual_ticket_key_a").eqNullSafe(F.col("actual_ticket_key_b"))


def changed_cases(one: DataFrame, other: DataFrame) -> DataFrame:
    """A14. (key, actual_ticket_key_a, actual_ticket_key_b): the cases of both sides whose ticket differs (null-safe)."""
    a, b = (df.select("key", F.col("actual_ticket_key").alias(f"actual_ticket_key_{s}")) for df, s in ((one, "a"), (other, "b")))
    return a.join(b, "key").filter(_ticket_differs())


def compare_ab(one: DataFrame, other: DataFrame, stage: str = "reranking") -> DataFrame:
    """A14. One row: how often the ticket differs (null-safe), times, accuracy and recall@3 per side. Where it differs is
    told by changed_cases()."""
    pick = lambda df, s: df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("actual_ticket_key", "correct", "difficulty", "recall3", "elapsed_s")], *([F.coalesce(F.col("timings_ms")[stage], F.lit(0.0)).alias("ms")] if s == "a" else []))
    both = pick(one, "a").join(pick(other, "b"), "key")

    def side(s):
        clear = ~F.col(f"difficulty_{s}").eqNullSafe("hard")
        n = F.count_if(clear)
        r = F.count(f"recall3_{s}")
        return [
            F.avg(f"elapsed_s_{s}").alias(f"avg_elapsed_s_{s}"), F.when(n > 0, F.count_if(clear & F.col(f"correct_{s}")) / n).alias(f"clear_accuracy_{s}"),
            F.when(r > 0, F.count_if(f"recall3_{s}") / r).alias(f"recall3_{s}"),
        ]

    return both.agg(F.count("*").alias("n"), F.count_if(_ticket_differs()).alias("changed"), F.avg("ms").alias("avg_rerank_ms"), *side("a"), *side("b"))


def validate_pairs(one: DataFrame, other: DataFrame) -> DataFrame:
    """A15. (key, notes, ok) from (key, path, pool, sent, blocks) of both variants."""
    a, b = (df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("path", "pool", "sent", "blocks")]) for df, s in ((one, "a"), (other, "b")))
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    df = a.join(b, "key")
    checks = [
        (~F.col("path_a").eqNullSafe(F.col("path_b")), "path"), (as_set(F.col("pool_a")) != as_set(F.col("pool_b")), "candidate pool"),
        (F.coalesce("sent_a", F.lit(0)) != F.coalesce("sent_b", F.lit(0)), "count sent"), (F.coalesce("blocks_a", F.lit(0)) != F.coalesce("blocks_b", F.lit(0)), "prompt blocks"),
    ]
    notes = F.array_compact(F.array(*[F.when(c, F.lit(f"{n} differs")) for c, n in checks]))
    return df.select("key", notes.alias("notes")).withColumn("ok", F.size("notes") == 0)


def stage_timings(results: DataFrame, accuracy: int | None = 10_000) -> DataFrame:
    """A16. (stage, n, mean_ms, p50_ms, p95_ms) over the rows that ran the stage, and the stage `total` per row.

    The percentiles are a row's value whose rank is off by at most n / accuracy; accuracy None gives exact ones,
    interpolated between the two rows around the place.
    """
    each = results.select(F.explode("timings_ms").alias("stage", "ms"))
    total = results.filter("timings_ms IS NOT NULL").select(F.lit("total").alias("stage"), F.aggregate(F.map_values("timings_ms"), F.lit(0.0), lambda a, x: a + x).alias("ms"))
    df = each.unionByName(total).filter("ms IS NOT NULL")
    if accuracy is None:
        exact = quantiles(df, "ms", [0.5, 0.95], ["stage"]).select("stage", F.col("q0").alias("p50_ms"), F.col("q1").alias("p95_ms"))
        return df.groupBy("stage").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms")).join(exact, "stage", "left")
    return df.groupBy("stage").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.percentile_approx("ms", 0.5, accuracy).alias("p50_ms"), F.percentile_approx("ms", 0.95, accuracy).alias("p95_ms"))
