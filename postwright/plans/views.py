"""Base tables built from the given parquet tables; the expressions are valid in Spark and in ANSI SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATEGORIES, STATUSES

#: Time at which recency is measured.
NOW = "2024-03-01 00:00:00"
TICKET = "CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id * 8 + event_id % 8 END"
_case = lambda c, values: f"CASE {c} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"

CUSTOMERS = ("customer", {"id": "c_custkey", "name": "c_name", "inbox_email": "'Billing' || CAST(c_custkey AS STRING) || '@Clinic.example'", "balance": "c_acctbal"})
INTERACTIONS = (
    "events",
    {
        "id": "event_id", "interaction_id": "event_id", "customer_id": "user_id", "ticket_id": TICKET, "created_at": "CAST(ts AS TIMESTAMP)",
        "interaction_type": "CASE event_type WHEN 'purchase' THEN 'agent_reply' WHEN 'signup' THEN 'internal_note' WHEN 'error' THEN 'system_event' ELSE 'customer_email' END",
        "message_id": "'m' || CAST(event_id AS STRING)", "conversation_id": f"'c' || CAST({TICKET} AS STRING)", "clean_content": "props",
        "embedding_model": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'old' ELSE 'new' END", "embedding": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END",
    },
)
EMAILS = (
    "events",
    {
        "query_id": "event_id", "sender_email": "chr(9) || ' billing' || CAST(user_id + CASE WHEN event_id % 11 = 0 THEN 100000000 ELSE 0 END AS STRING) || '@CLINIC.example' || chr(160) || chr(10)",
        "conversation_id": "CASE WHEN event_id % 4 = 0 THEN 'c' || CAST(user_id * 8 + event_id % 8 AS STRING) WHEN event_id % 4 = 1 THEN '' END",
        "in_reply_to": "CASE WHEN event_id % 3 = 0 THEN 'm' || CAST(event_id - 7 AS STRING) END", "ref1": "'m' || CAST(event_id - 11 AS STRING)", "ref2": "'m' || CAST(event_id + 1 AS STRING)",
    },
)
FEEDBACK = (
    "events",
    {
        "id": "event_id", "customer_id": "user_id", "created_at": "CAST(ts AS TIMESTAMP)", "should_attach": "event_type IN ('click', 'purchase')", "manager_decision": "CASE WHEN event_id % 3 <> 0 THEN 'accepted' ELSE 'rejected' END",
        "confidence": "least(value / 500, 1.0)", "recommended_ticket_id": TICKET, "corrected_ticket_id": "CASE WHEN event_id % 6 = 0 THEN user_id * 8 + (event_id + 1) % 8 END",
    },
)
EVAL = (
    "events",
    {
        "key": "'q' || CAST(event_id % 500 AS STRING)", "run": "CAST(CAST(ts AS DATE) AS STRING)", "generated_at": "CASE WHEN event_id % 2 = 0 THEN CAST(CAST(ts AS DATE) AS STRING) END",
        "category": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'easy_mail' WHEN 2 THEN 'thread' ELSE 'lookalike' END", "difficulty": "CASE WHEN event_id % 9 = 0 THEN 'hard' ELSE 'clear' END",
        "ambiguity_type": "CASE WHEN event_id % 2 = 0 THEN 'multi_acceptable' WHEN event_id % 5 = 0 THEN 'other' END", "expected": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 't' || CAST(user_id % 7 AS STRING) END",
        "actual_ticket_key": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 't' || CAST((user_id + CASE WHEN event_id % 8 = 0 THEN 1 ELSE 0 END) % 7 AS STRING) END",
        "recall20": "CASE WHEN event_id % 10 = 3 THEN NULL ELSE event_id % 13 <> 0 END", "recall3": "CASE WHEN event_id % 10 = 3 THEN NULL ELSE event_id % 7 <> 0 END",
        "confidence": "least(value / 500, 1.0)", "elapsed_s": "value / 10", "event_id": "event_id",
    },
)
UNITS = (
    "events",
    {
        "unit_id": "event_id", "stage": "CASE user_id % 4 WHEN 0 THEN 'customers' WHEN 1 THEN 'tickets' WHEN 2 THEN 'conversations' ELSE 'queries' END", "artifact": "CASE user_id % 4 WHEN 0 THEN 'customers' WHEN 1 THEN 'tickets' WHEN 2 THEN 'conversations' ELSE 'queries' END",
        "status": "CASE WHEN user_id % 4 = 0 THEN 'qa_pass' ELSE CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'qa_pass' WHEN 'purchase' THEN 'qa_flag' WHEN 'error' THEN 'errored' ELSE 'qa_fail' END END",
        "retry_count": "event_id % 5", "verdict": "CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'flag' WHEN 'view' THEN CASE WHEN user_id % 4 = 1 THEN 'flag' ELSE 'pass' END ELSE 'pass' END",
    },
)
BIG_TICKETS = (
    "orders",
    {
        "id": "o_orderkey", "customer_id": "o_custkey", "subject": "o_orderpriority || ' order ' || CAST(o_orderkey % 40 AS STRING) || ' of ' || CAST(o_custkey % 9 AS STRING)", "category": "o_orderpriority",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'PENDING' END", "created_at": "o_orderdate",
    },
)


def sql_of(view: tuple[str, dict[str, str]]) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in view[1].items()) + f" FROM {view[0]})"


#: SQL of the tickets that the interactions imply.
TICKETS_SQL = f"""(SELECT id, customer_id, CASE WHEN status IN ('RESOLVED', 'CLOSED') THEN last_at END AS closed_at, created_at, category, status, 'Ticket ' || CAST(id AS STRING) AS subject
    FROM (SELECT ticket_id AS id, min(customer_id) AS customer_id, min(created_at) AS created_at, max(created_at) AS last_at, {_case('ticket_id % 6', CATEGORIES)} AS category,
                 {_case('ticket_id % 11 % 6', STATUSES)} AS status FROM {sql_of(INTERACTIONS)} AS i WHERE ticket_id IS NOT NULL GROUP BY ticket_id) AS t)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, spec: tuple[str, dict[str, str]]) -> DataFrame:
    return read(spark, sf_dir, spec[0]).selectExpr(*[f"{e} AS {n}" for n, e in spec[1].items()])


def customers(spark, sf_dir):
    return view(spark, sf_dir, CUSTOMERS)


def interactions(spark, sf_dir):
    return view(spark, sf_dir, INTERACTIONS)


def tickets(spark, sf_dir):
    rows = interactions(spark, sf_dir).filter("ticket_id IS NOT NULL").groupBy("ticket_id")
    df = rows.agg(F.min("customer_id").alias("customer_id"), F.min("created_at").alias("created_at"), F.max("created_at").alias("last_at"))
    df = df.selectExpr("ticket_id AS id", "customer_id", "created_at", "last_at", f"{_case('ticket_id % 6', CATEGORIES)} AS category", f"{_case('ticket_id % 11 % 6', STATUSES)} AS status")
    return df.selectExpr("id", "customer_id", "CASE WHEN status IN ('RESOLVED', 'CLOSED') THEN last_at END AS closed_at", "created_at", "category", "status", "'Ticket ' || CAST(id AS STRING) AS subject")
