"""From hits to tickets: scores, context texts, reranking and the decision."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ..functions.scalars import recency, sender_label
from ..functions.text import bind, words
from .retrieval import top_n


def hits_to_tickets(hits: DataFrame, interactions: DataFrame) -> DataFrame:
    """J14. Add ticket_id and created_at; hits without a ticket go."""
    rows = interactions.select("interaction_id", "ticket_id", "created_at").filter("ticket_id IS NOT NULL")
    return hits.join(rows, "interaction_id")


def score_tickets(hits: DataFrame, now: Column, top_k: int = 3, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), half_life: float = 14.0, m: int = 20) -> DataFrame:
    """A1. The first m tickets of each query by final score.

    hits (query_id, ticket_id, interaction_id, created_at, keyword_score, vector_score, rank). A hit's match score
    is its cosine, else its keyword score, else 0, never the fused one. final = weights . (greatest match score,
    mean of the top_k, recency of the newest matched interaction). matched_ids are ordered by score, ties by
    fused rank; tickets with equal scores by their best fused rank.
    """
    match = F.coalesce("vector_score", "keyword_score", F.lit(0.0))
    place = Window.partitionBy("query_id", "ticket_id").orderBy(F.desc(F.round("match", 9)), "rank")
    df = hits.withColumn("match", match).withColumn("place", F.row_number().over(place))
    df = df.groupBy("query_id", "ticket_id").agg(
        F.max("match").alias("max_score"),
        F.avg(F.when(F.col("place") <= top_k, F.col("match"))).alias("avg_top"),
        F.max("created_at").alias("newest"),
        F.min("rank").alias("best_rank"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "interaction_id"))), lambda x: x.interaction_id).alias("matched_ids"),
    )
    df = df.withColumn("recency", recency("newest", now, half_life))
    final = weights[0] * F.col("max_score") + weights[1] * F.col("avg_top") + weights[2] * F.col("recency")
    df = df.withColumn("final_score", final)
    return top_n(df, ["query_id"], [F.desc(F.round("final_score", 9)), "best_rank"], m, "ticket_rank").drop("newest")


def context_windows(candidates: DataFrame, interactions: DataFrame, before: int = 1, after: int = 1, most_matched: int = 2) -> DataFrame:
    """W3. (query_id, ticket_id, idx, interaction columns): neighbours of the first matched interactions.

    Positions count all types of a ticket's interactions, from 1, by time then id. Windows are clamped at the
    ends, and overlaps merge. Only candidate tickets' timelines are built.
    """
    wanted = candidates.select("query_id", "ticket_id", F.slice("matched_ids", 1, most_matched).alias("first_ids"))
    rows = interactions.join(wanted.select("ticket_id").distinct(), "ticket_id", "left_semi")
    timeline = rows.withColumn("idx", F.row_number().over(Window.partitionBy("ticket_id").orderBy("created_at", "interaction_id")))
    marks = wanted.select("query_id", "ticket_id", F.explode("first_ids").alias("interaction_id")).join(timeline.select("ticket_id", "interaction_id", "idx"), ["ticket_id", "interaction_id"])
    near = marks.select("query_id", "ticket_id", F.explode(F.sequence(F.col("idx") - before, F.col("idx") + after)).alias("idx")).distinct()
    return near.join(timeline, ["ticket_id", "idx"])


def context_text(windows: DataFrame, tickets: DataFrame) -> DataFrame:
    """M3. (query_id, ticket_id, context): a header line and one labelled block per interaction, in time order.

    tickets (ticket_id, customer_name, status, subject).
    """
    block = F.concat(F.lit("--- Interaction ("), sender_label("interaction_type"), F.lit(") ---\n"), F.coalesce("clean_content", F.lit("")))
    blocks = windows.groupBy("query_id", "ticket_id").agg(F.array_sort(F.collect_list(F.struct("idx", block.alias("text")))).alias("blocks"))
    head = F.concat(F.lit("Ticket ID: "), F.col("ticket_id").cast("string"), F.lit(" | Customer: "), "customer_name", F.lit(" | Status: "), "status", F.lit(" | Subject: "), "subject")
    body = F.array_join(F.transform("blocks", lambda x: x.text), "\n")
    return blocks.join(tickets, "ticket_id").select("query_id", "ticket_id", F.concat_ws("\n", head, body).alias("context"))


def lexical_overlap(query_text: Column, context: Column) -> Column:
    """The default pair score: the share of the query's distinct words that the context has."""
    q, c = F.array_distinct(words(query_text)), F.array_distinct(words(context))
    return F.coalesce(F.size(F.array_intersect(q, c)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


_LOADED: dict[str, Callable] = {}


def _made_once(name: str, load: Callable[[], Callable]) -> Callable:
    """What load() gives, made once in a Python worker, which Spark uses for many tasks."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def _by_length(lengths: list[int], batch: int) -> list[list[int]]:
    """Positions in batches of alike lengths, so that a model pads little."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    return [order[i : i + batch] for i in range(0, len(order), batch)]


def _counted(made: list, n: int, what: str) -> list:
    if len(made) != n:
        raise ValueError(f"{len(made)} {what} for {n} texts")
    return made


def pair_scorer(score: Callable[[list[str], list[str]], list[float]] | None = None, load: Callable[[], Callable] | None = None, batch: int = 64):
    """M2. A vectorized column function from a batch scorer of text pairs, such as a cross-encoder.

    load, instead of score, is called once in each Python worker and gives the scorer, so a model is read once and not
    sent with the task. Pairs go to it in batches of alike length; scores come back in the order of the rows.
    """
    name = uuid.uuid4().hex
    load = load or (lambda: score)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = _made_once(name, load)
        for q, c in parts:
            qs, cs, out = q.tolist(), c.tolist(), [0.0] * len(q)
            for at in _by_length([len(x or "") + len(y or "") for x, y in zip(qs, cs, strict=True)], batch):
                made = _counted(list(scorer([qs[i] for i in at], [cs[i] for i in at])), len(at), "scores")
                for i, x in zip(at, made, strict=True):
                    out[i] = x
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(run, DoubleType())


def batch_embedder(embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 16, load: Callable[[], Callable] | None = None):
    """M1. A vectorized column function text -> vector from a batch embedder; one vector per text, in order.

    load, instead of embed, is called once in each Python worker and gives the embedder (see pair_scorer).
    """
    name = uuid.uuid4().hex
    load = load or (lambda: embed)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = _made_once(name, load)
        for part in parts:
            texts, out = part.tolist(), [None] * len(part)
            for at in _by_length([len(x or "") for x in texts], batch):
                for i, v in zip(at, _counted(list(embedder([texts[i] for i in at])), len(at), "vectors"), strict=True):
                    out[i] = v
            yield pd.Series(out, dtype="object")

    return F.pandas_udf(run, ArrayType(FloatType()))


def hashed_embedding(c, dims: int = 64) -> Column:
    """The default embedding: hashed counts of words, normalised, in built-in functions; zeros without words."""

    def counted(slots: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return bind(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    slots = F.transform(words(c), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    return bind(bind(slots, counted), scaled)


def rerank(candidates: DataFrame, scorer=lexical_overlap, top_k: int = 3) -> DataFrame:
    """M2. The top_k candidates (query_id, ticket_id, query_text, context, ticket_rank) by pair score."""
    df = candidates.withColumn("rerank_score", scorer(F.col("query_text"), F.col("context")))
    return top_n(df, ["query_id"], [F.desc(F.round("rerank_score", 9)), "ticket_rank"], top_k, "position")


def decision_input(ranked: DataFrame, score: str = "rerank_score", label: str = "cross-encoder score") -> DataFrame:
    """M4. (query_id, candidates, prompt): candidates numbered from 1 with their score to three decimals."""
    block = F.format_string("=== Candidate %d (%s: %.3f) ===\n%s", F.col("position"), F.lit(label), F.col(score), F.col("context"))
    df = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "ticket_id", F.col(score).alias("score"), block.alias("text")))).alias("candidates"))
    return df.withColumn("prompt", F.array_join(F.transform("candidates", lambda x: x.text), "\n\n"))


def threshold_decider(least: float = 0.5):
    """The default decider: candidate 1 if its score is enough."""

    def decide(candidates: Column) -> Column:
        top = F.get(candidates, F.lit(0)).score
        return F.struct((top >= least).alias("attach"), F.when(top >= least, 1).alias("index"), top.alias("confidence"))

    return decide


def decide(queries: DataFrame, inputs: DataFrame, decider=None) -> DataFrame:
    """M5. Add should_attach, decided_ticket_id and confidence to queries.

    decider maps the array of candidates to struct<attach, index, confidence>. No index with attach means the
    first candidate; an index out of range means no attachment; no candidates no attachment, confidence 1.
    """
    made = (decider or threshold_decider())(F.col("candidates"))
    df = queries.join(inputs.select("query_id", "candidates", made.alias("d")), "query_id", "left")
    some = F.coalesce(F.size("candidates") > 0, F.lit(False))
    at = F.coalesce("d.index", F.lit(1)) - 1
    ticket = F.when(some & F.col("d.attach") & (at >= 0), F.get("candidates", at).ticket_id)
    df = df.withColumn("decided_ticket_id", ticket)
    return df.withColumn("should_attach", F.col("decided_ticket_id").isNotNull()).withColumn("confidence", F.when(some, F.col("d.confidence")).otherwise(F.lit(1.0))).drop("d")
