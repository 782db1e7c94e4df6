"""The whole way from incoming mail to a recommended ticket, and evaluation on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import clean_text, embedding_text, normalize_email, with_lexemes
from ..operators import evaluation, ranking, retrieval, routing
from ..operators.filters import is_embeddable
from ..sources.scratch import Scratch


def prepare_emails(emails: DataFrame, embed=ranking.hashed_embedding, clean=clean_text) -> DataFrame:
    """Add query_text, lexemes and embedding to (query_id, subject, body, ...)."""
    df = emails if "query_text" in emails.columns else emails.withColumn("query_text", embedding_text("subject", clean("body")))
    return with_lexemes(df, "query_id", "query_text").withColumn("embedding", embed(F.col("query_text")))


def rank_tickets(queries: DataFrame, interactions: DataFrame, now: Column, match: str = "all", **options) -> DataFrame:
    """J13, J14, A1: scored tickets of prepared queries with a customer_id."""
    hits = retrieval.hybrid_search(queries, interactions, match=match)
    return ranking.score_tickets(ranking.hits_to_tickets(hits, interactions), now, **options)


def recommend(emails: DataFrame, customers: DataFrame, tickets: DataFrame, interactions: DataFrame, now: Column, scorer=ranking.lexical_overlap, decider=None, embed=ranking.hashed_embedding, clean=clean_text, match: str = "all", rerank: bool = True, top_k: int = 3) -> DataFrame:
    """(query_id, path, customer_id, recommended_ticket_id, should_attach, confidence, n_candidates, ambiguous_inbox, pool, finalists) for each email.

    Mail of unknown senders and of live threads is settled by joins; only the rest takes the heavy path. Without
    rerank (M6) the first top_k tickets by final score go to the decision as they stand. interactions needs
    lexemes and embedding beside its own columns. What several steps read is written once (routed mail, prepared mail,
    the searched part of the interactions, ranked tickets), so no step is computed twice and each has a short plan.
    ambiguous_inbox marks mail to an inbox of several customers, which goes to the one with the smallest id. pool holds the
    tickets found (at most 20, best first) and finalists those put to the decision; both are null off the heavy path.
    """
    scratch = Scratch(emails.sparkSession)
    routed = scratch.write(routing.route(emails, customers, interactions, tickets))
    heavy = scratch.write(prepare_emails(scratch.write(routed.filter("path = 'ai_decision'").withColumn("query_text", embedding_text("subject", clean("body")))), embed))
    asked = heavy.select("customer_id").distinct()
    searched = scratch.write(interactions.filter(is_embeddable()).join(asked, "customer_id", "left_semi").select("interaction_id", "customer_id", "ticket_id", "created_at", "interaction_type", "lexemes", "embedding"))
    ranked = scratch.write(rank_tickets(heavy, searched, now, match))
    pools = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ticket_rank", "ticket_id"))).alias("pool"))
    if not rerank:
        ranked = ranked.filter(F.col("ticket_rank") <= top_k)
    names = tickets.select(F.col("id").alias("ticket_id"), "customer_id", "status", "subject").join(customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name")), "customer_id").drop("customer_id")
    contexts = ranking.context_text(ranking.context_windows(ranked, interactions), names)
    full = ranked.join(contexts, ["query_id", "ticket_id"]).join(heavy.select("query_id", "query_text"), "query_id")
    if rerank:
        inputs = ranking.decision_input(ranking.rerank(full, scorer, top_k))
    else:
        inputs = ranking.decision_input(full.withColumn("position", F.col("ticket_rank")), "final_score", "match score")
    decided = ranking.decide(heavy.select("query_id"), inputs, decider)
    shared = routing.ambiguous_inboxes(customers).select("inbox").withColumn("ambiguous_inbox", F.lit(True))
    out = routed.join(decided, "query_id", "left").join(pools, "query_id", "left").join(shared, normalize_email("sender_email") == F.col("inbox"), "left")
    ticket = routing.recommended_ticket()
    ids = lambda c: F.when(F.col("path") == "ai_decision", F.coalesce(F.transform(c, lambda x: x.ticket_id), F.array().cast(ArrayType(tickets.schema["id"].dataType))))
    made = out.select("query_id", "path", "customer_id", ticket.alias("recommended_ticket_id"), ticket.isNotNull().alias("should_attach"), F.when(F.col("path") == "ai_decision", F.col("confidence")).alias("confidence"), F.size("candidates").alias("n_candidates"), F.coalesce("ambiguous_inbox", F.lit(False)).alias("ambiguous_inbox"), ids("pool").alias("pool"), ids("candidates").alias("finalists"))
    return scratch.last(made)


def evaluate(results: DataFrame, expected: DataFrame, run: str) -> DataFrame:
    """Eval rows, as the roll-ups of operators/evaluation.py take them, from recommend() and
    (key, expected_ticket_keys, difficulty, ambiguity_type, category).

    recall20 is whether an expected ticket was found, recall3 whether it was put to the decision; both are null where
    nothing is expected or mail was settled without search. A case without a result has no ticket. Batches have no
    time of a single mail, so elapsed_s is null.
    """
    df = expected.join(results.select(F.col("query_id").alias("key"), F.col("recommended_ticket_id").alias("actual_ticket_key"), "path", "confidence", "pool", "finalists"), "key", "left")
    df = df.withColumns({"correct": evaluation.is_correct(), "recall20": evaluation.recall(), "recall3": evaluation.recall(pool="finalists")})
    return df.withColumns({"run": F.lit(run), "generated_at": F.lit(None).cast("string"), "elapsed_s": F.lit(None).cast("double")}).drop("pool", "finalists")
