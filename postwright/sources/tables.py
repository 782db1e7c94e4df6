"""Sources and sinks."""

from __future__ import annotations

import datetime
import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import days_ago, derive_thread, offset_to_ts, stable_uuid
from .json_records import json_records


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S1. The four base tables, with declared schemas."""
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in schemas.TABLES.items()}


def range_predicates(column: str, bounds: list) -> list[str]:
    """Conditions that split a table by sorted bounds of a column: each row meets exactly one, nulls the first."""
    marks = [f"'{b}'" if not isinstance(b, int | float) else str(b) for b in bounds]
    if not marks:
        return ["1 = 1"]
    between = [f"{column} >= {lo} AND {column} < {hi}" for lo, hi in itertools.pairwise(marks)]
    return [f"{column} < {marks[0]} OR {column} IS NULL", *between, f"{column} >= {marks[-1]}"]


def declared(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns, order and types of a schema; names match in any case, arrays and maps may come as JSON."""
    have = {c.lower(): (c, kind) for c, kind in df.dtypes}
    out = []
    for field in _fields(ddl):
        name, kind = field.split(" ", 1)
        if name.lower() not in have:
            raise ValueError(f"column {name} is missing")
        column, source = have[name.lower()]
        nested = kind.startswith(("array<", "map<", "struct<")) and source == "string"
        out.append((F.from_json(F.col(column), kind) if nested else F.col(column).cast(kind)).alias(name))
    return df.select(*out)


def read_tables_jdbc(spark: SparkSession, url: str, bounds: dict[str, list] | None = None, key: str = "id", properties: dict[str, str] | None = None, names: dict[str, str] | None = None, schemas_of: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """S1 from a database: the base tables with declared schemas, each read in ranges of its key by as many tasks.

    bounds gives sorted keys that split a table (for random ids, their first characters); a table without is one
    range, and strings are compared as the database compares them. names maps a table to its name in the database. Column
    pruning and filters go to the database.
    """
    out = {}
    for table, ddl in (schemas_of or schemas.TABLES).items():
        parts = range_predicates(key, (bounds or {}).get(table, []))
        out[table] = declared(spark.read.jdbc(url, (names or {}).get(table, table), predicates=parts, properties=properties or {}), ddl)
    return out


def load_fixture(customers: DataFrame, tickets: DataFrame, threads: DataFrame, namespace: str, anchor: datetime.datetime, agent_domain: str = "support.example") -> dict[str, DataFrame]:
    """S2. Timeline tables from keyed rows: stable ids, ages as timestamps, thread fields.

    customers (key, name, inbox_email), tickets (key, customer, category, subject, status, age_days,
    closed_age_days), threads (ticket_key, messages array of sender, type, offset_hours, content,
    sender_email_override).
    """
    cust = customers.select(stable_uuid(namespace, "key").alias("id"), "name", "inbox_email", F.lit(anchor).alias("created_at"), "key")
    owner = cust.select(F.col("id").alias("customer_id"), F.col("key").alias("customer"), "inbox_email")
    tick = tickets.join(owner, "customer").select(
        stable_uuid(namespace, "key").alias("id"), "customer_id", "subject", "category", "status",
        days_ago(anchor, "age_days").alias("created_at"), days_ago(anchor, "closed_age_days").alias("closed_at"), "key", "inbox_email",
    )
    msgs = threads.select("ticket_key", F.posexplode("messages").alias("pos", "m")).withColumn("position", F.col("pos") + 1)
    kinds = F.coalesce("m.type", F.when(F.col("m.sender") == "customer", "customer_email").otherwise("agent_reply"))
    msgs = msgs.join(tick.withColumnsRenamed({"key": "ticket_key", "id": "ticket_id"}), "ticket_key").select("*", "m.sender", kinds.alias("interaction_type"))
    msgs = derive_thread(msgs, agent_domain=agent_domain)
    sender = F.coalesce("m.sender_email_override", F.when(F.col("sender") == "customer", F.col("inbox_email")).otherwise(F.lit(f"agent@{agent_domain}")))
    rows = msgs.select(
        stable_uuid(namespace, F.format_string("%s-msg%02d", F.col("ticket_key"), F.col("position"))).alias("id"), "ticket_id", "customer_id", "interaction_type",
        sender.alias("sender_email"), F.col("m.content").alias("raw_content"), F.col("m.content").alias("clean_content"), "message_id",
        F.format_string("<conv-%s@%s>", F.lower("ticket_key"), F.lit(agent_domain)).alias("conversation_id"), "in_reply_to", "reference_message_ids",
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"),
        F.lit(None).cast("map<string,string>").alias("extra_metadata"), offset_to_ts("created_at", "m.offset_hours").alias("created_at"),
    )
    return {"customers": cust.drop("key"), "tickets": tick.drop("key", "inbox_email"), "interactions": rows}


def union_corpora(*corpora: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """U5. The tables of several corpora as one; ids come from each one's namespace, and a row with a known id is one row."""
    out = dict(corpora[0])
    for more in corpora[1:]:
        out = {name: upsert(df, more[name]) if name in more else df for name, df in out.items()} | {n: d for n, d in more.items() if n not in out}
    return out


def upsert(target: DataFrame, updates: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """S3. target with the rows of updates in place of those with the same key; repeatable.

    Of several updates with one key, the last by `order` counts (without it, one of them).
    """
    if order:
        latest = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
        updates = updates.withColumn("up__n", F.row_number().over(latest)).filter("up__n = 1").drop("up__n")
    else:
        updates = updates.dropDuplicates([key])
    return target.join(updates.select(key), key, "left_anti").unionByName(updates)


def _run():
    """A file's own name."""
    return F.element_at(F.split("file", "/"), -1)


def read_eval_runs(spark: SparkSession, glob: str) -> DataFrame:
    """S4. (run, generated_at, result columns) of eval files, which are an object with results or a bare list.

    Files are read piecewise (json_records), so a large one is shared by several tasks.
    """
    rows = json_records(spark, glob).filter("name IN ('', 'results')")
    made = F.regexp_extract("outer", r'"generated_at"\s*:\s*("(?:[^"\\]|\\.)*+")', 1)
    made = F.when(F.col("name") == "results", F.from_json(F.concat(F.lit('{"x":'), made, F.lit("}")), "x string").x)
    return rows.select(_run().alias("run"), made.alias("generated_at"), F.from_json("record", schemas.EVAL_RESULT).alias("r")).select("run", "generated_at", "r.*")


def _fields(ddl: str) -> list[str]:
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def read_repeat_runs(spark: SparkSession, glob: str) -> DataFrame:
    """S5. One row per key and attempt (from 1); files are read piecewise."""
    kind = schemas.REPEAT_FILE.removeprefix("queries array<").removesuffix(">")
    df = json_records(spark, glob).filter("name = 'queries'").select("file", F.from_json("record", kind).alias("q"))
    df = df.select("file", "q.*").select("file", "key", "category", "difficulty", "ambiguity_type", "expected_ticket_keys", F.posexplode("runs").alias("attempt", "r"))
    return df.select(_run().alias("run"), "key", "category", "difficulty", "ambiguity_type", "expected_ticket_keys", (F.col("attempt") + 1).alias("attempt"), "r.*")


def read_ab_run(spark: SparkSession, glob: str) -> DataFrame:
    """S6. Rows of both variants of the A/B file with the greatest name, which is read piecewise; others aren't read."""
    last = spark.read.format("binaryFile").load(glob).agg(F.max("path")).first()[0]
    rows = json_records(spark, last or glob).filter("name IN ('with_reranker', 'no_reranker')")
    return rows.select(_run().alias("run"), F.col("name").alias("variant"), F.from_json("record", schemas.EVAL_RESULT).alias("r")).select("run", "variant", "r.*")


def read_qa_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """S7. customers, tickets, conversations or labels of the QA track."""
    ddl = {"customers": schemas.QA_CUSTOMER, "tickets": schemas.QA_TICKET, "conversations": schemas.QA_CONVERSATION, "labels": schemas.QA_LABEL}[kind]
    return spark.read.schema(ddl).json(path, multiLine=True)


def write_results(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """S8."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).format(fmt).save(path)
