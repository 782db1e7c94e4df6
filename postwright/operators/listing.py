"""Listings, counts and references for a dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview
from .filters import matching
from .ordering import page



def tickets_with_customers(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    """J7."""
    return tickets.join(customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name")), "customer_id")


def add_refs(df: DataFrame, tickets: DataFrame, customers: DataFrame, columns: dict[str, str]) -> DataFrame:
    """J8. For each (id column -> name) a struct of the ticket's id, subject, category, status and customer_name."""
    known = tickets_with_customers(tickets, customers)
    for c, name in columns.items():
        ref = known.select(F.col("id").alias("ref__id"), F.struct("id", "subject", "category", "status", "customer_name").alias(name))
        df = df.join(ref, F.col(c) == F.col("ref__id"), "left").drop("ref__id")
    return df


def customers_with_counts(customers: DataFrame, tickets: DataFrame) -> DataFrame:
    """A2. (id, name, inbox_email, ticket_count), customers without tickets included."""
    n = tickets.groupBy(F.col("customer_id").alias("id")).agg(F.count("*").alias("ticket_count"))
    return customers.join(n, "id", "left").select("id", "name", "inbox_email", F.coalesce("ticket_count", F.lit(0)).alias("ticket_count"))


def tickets_with_counts(tickets: DataFrame, customers: DataFrame, interactions: DataFrame, **equal) -> DataFrame:
    """A3. Filtered tickets with customer_name, interaction_count and the total of all that match."""
    n = interactions.groupBy(F.col("ticket_id").alias("id")).agg(F.count("*").alias("interaction_count"))
    df = tickets_with_customers(matching(tickets, **equal), customers).join(n, "id", "left")
    return df.withColumn("interaction_count", F.coalesce("interaction_count", F.lit(0)))


def list_interactions(interactions: DataFrame, limit: int = 50, offset: int = 0, has_embedding: bool | None = None, **equal) -> DataFrame:
    """P5. A page of the newest interactions, with total, the number that match, and a preview."""
    found = matching(interactions, has_embedding, **equal)
    total = found.agg(F.count("*").alias("total"))
    rows = page(found, [F.desc("created_at"), "id"], limit, offset)
    return rows.crossJoin(F.broadcast(total)).withColumn("preview", preview("clean_content"))


def ticket_timeline(interactions: DataFrame) -> DataFrame:
    """P6. (ticket_id, n, first_at, last_at, timeline): interactions of each ticket, oldest first."""
    item = F.struct("created_at", "id", "interaction_type")
    df = interactions.filter("ticket_id IS NOT NULL").groupBy("ticket_id").agg(
        F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.array_sort(F.collect_list(item)).alias("timeline")
    )
    return df


def list_feedback(feedback: DataFrame, tickets: DataFrame, customers: DataFrame, limit: int = 50, offset: int = 0, customer_id=None) -> DataFrame:
    """P7. A page of the newest feedback with total and references to both tickets."""
    found = matching(feedback, customer_id=customer_id)
    total = found.agg(F.count("*").alias("total"))
    rows = page(found, [F.desc("created_at"), "id"], limit, offset).crossJoin(F.broadcast(total))
    return add_refs(rows, tickets, customers, {"recommended_ticket_id": "recommended", "corrected_ticket_id": "corrected"})


def system_counts(customers: DataFrame, tickets: DataFrame, interactions: DataFrame) -> DataFrame:
    """A4. One row."""
    c, t = customers.agg(F.count("*").alias("customers")), tickets.agg(F.count("*").alias("tickets"))
    i = interactions.agg(F.count("*").alias("interactions"), F.count("embedding").alias("embedded"))
    return c.crossJoin(t).crossJoin(i)
