"""Sender and thread lookups for incoming mail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_email
from .filters import is_terminal


def ambiguous_inboxes(customers: DataFrame) -> DataFrame:
    """Inbox addresses of several customers; a lookup by them is an error for the caller to settle."""
    return customers.groupBy(F.lower("inbox_email").alias("inbox")).agg(F.count("*").alias("n")).filter("n > 1")


def identify_customer(emails: DataFrame, customers: DataFrame) -> DataFrame:
    """J1. Add customer_id by normalised sender. An ambiguous inbox gives the smallest id and doesn't fan out."""
    known = customers.groupBy(F.lower("inbox_email").alias("sender__key")).agg(F.min("id").alias("customer_id"))
    return emails.withColumn("sender__key", normalize_email("sender_email")).join(known, "sender__key", "left").drop("sender__key")


def latest_of_conversations(interactions: DataFrame) -> DataFrame:
    """W5. (conversation_id, interaction_id, ticket_id) of the newest interaction; ties to the greater id."""
    rows = interactions.filter("conversation_id IS NOT NULL AND conversation_id <> ''")
    newest = F.max(F.struct("created_at", F.col("id").alias("interaction_id"), "ticket_id"))
    return rows.groupBy("conversation_id").agg(newest.alias("x")).select("conversation_id", "x.interaction_id", "x.ticket_id")


def _hit(kind: str):
    return F.struct(F.col("ticket_id"), F.lit(kind).alias("matched_on"), F.col("interaction_id"))


def detect_thread(emails: DataFrame, interactions: DataFrame, tickets: DataFrame) -> DataFrame:
    """J2-J5. (query_id, ticket_id, matched_on, interaction_id) of emails that continue a live thread.

    Rules in order: the newest interaction of the conversation; the message replied to; the first reference. Each
    needs a ticket that isn't terminal, of whatever customer. Empty ids count as absent. Only ids that the emails
    name are looked up: the emails' side is reduced first, so null ids don't meet in one task.
    """
    live = tickets.filter(~is_terminal()).select(F.col("id").alias("ticket_id"))
    asked = emails.select("query_id", "conversation_id").filter("conversation_id <> ''")
    mentioned = interactions.join(asked.select("conversation_id").distinct(), "conversation_id", "left_semi")
    conv = asked.join(latest_of_conversations(mentioned), "conversation_id").join(live, "ticket_id")
    by_id = interactions.filter("message_id <> ''").select("message_id", "ticket_id", F.col("id").alias("interaction_id"))
    replies = emails.select("query_id", F.col("in_reply_to").alias("message_id"), F.lit(-1).alias("pos")).filter("message_id <> ''")
    refs = emails.select("query_id", F.posexplode("reference_message_ids").alias("pos", "message_id")).select("query_id", "message_id", "pos").filter("message_id <> ''")
    named = replies.unionByName(refs).join(by_id, "message_id").join(live, "ticket_id")
    found = conv.select("query_id", F.lit(-2).alias("pos"), _hit("conversation_id").alias("hit")).unionByName(
        named.select("query_id", "pos", F.when(F.col("pos") == -1, _hit("in_reply_to")).otherwise(_hit("reference_message_ids")).alias("hit"))
    )
    first = found.groupBy("query_id").agg(F.min(F.struct("pos", "hit")).alias("x"))
    return first.select("query_id", "x.hit.ticket_id", "x.hit.matched_on", "x.hit.interaction_id")


def route(emails: DataFrame, customers: DataFrame, interactions: DataFrame, tickets: DataFrame) -> DataFrame:
    """J6. Add customer_id, thread_ticket_id, matched_on and path: unknown_customer, auto_attach or ai_decision."""
    df = identify_customer(emails, customers)
    threads = detect_thread(df.filter("customer_id IS NOT NULL"), interactions, tickets)
    df = df.join(threads.select("query_id", F.col("ticket_id").alias("thread_ticket_id"), "matched_on"), "query_id", "left")
    path = F.when(F.col("customer_id").isNull(), "unknown_customer").when(F.col("thread_ticket_id").isNotNull(), "auto_attach").otherwise("ai_decision")
    return df.withColumn("path", path)


def recommended_ticket(path="path", thread="thread_ticket_id", decided="decided_ticket_id"):
    """M7."""
    return F.when(F.col(path) == "auto_attach", F.col(thread)).when(F.col(path) == "ai_decision", F.col(decided))


def latest_per_ticket(interactions: DataFrame, n: int = 10) -> DataFrame:
    """W4. The newest n interactions of each ticket."""
    w = Window.partitionBy("ticket_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return interactions.filter("ticket_id IS NOT NULL").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
