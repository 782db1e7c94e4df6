"""Ages, times, stable ids, thread fields and vectors."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CATEGORY_LABELS, SENDER_LABELS
from .text import bind


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_days(ts, now: Column) -> Column:
    """D1. Days before now, from microseconds; 0 for the future."""
    return F.greatest((F.unix_micros(now) - F.unix_micros(_col(ts).cast("timestamp"))) / 86_400e6, F.lit(0.0))


def recency(ts, now: Column, half_life: float = 14.0) -> Column:
    """D2. 0.5 ** (age / half_life)."""
    return F.pow(F.lit(0.5), age_days(ts, now) / half_life)


def days_ago(anchor: datetime.datetime | Column, days) -> Column:
    """D3. anchor less `days`, which may be fractional, with the clock set to 09:00."""
    anchor = anchor if isinstance(anchor, Column) else F.lit(anchor)
    moved = F.timestamp_micros(F.unix_micros(anchor) - F.round(_col(days) * 86_400e6).cast("long"))
    return F.date_trunc("DAY", moved) + F.expr("INTERVAL 9 HOURS")


def offset_to_ts(start, amount, unit: str = "hours") -> Column:
    """D4. start plus an amount of hours or days, fractions kept."""
    return F.timestamp_micros(F.unix_micros(_col(start)) + F.round(_col(amount) * {"hours": 3_600e6, "days": 86_400e6}[unit]).cast("long"))


def stable_uuid(namespace: uuid.UUID | str, key) -> Column:
    """D5. Version 5 UUID of the key in the namespace."""
    ns = str(namespace).replace("-", "")
    h = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(_col(key), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def derive_thread(messages: DataFrame, ticket: str = "ticket_key", position: str = "position", sender: str = "sender", kind: str = "interaction_type", email: str = "inbox_email", agent_domain: str = "support.example") -> DataFrame:
    """D6. Add message_id, in_reply_to and reference_message_ids.

    An id is made of the ticket's key, the two-digit position and the sender's domain. A message refers to all
    earlier ones of its ticket but notes, and replies to the last of these; notes refer to none.
    """
    domain = F.when(F.col(sender) == "customer", F.element_at(F.split(email, "@", 2), 2)).otherwise(F.lit(agent_domain))
    mid = F.format_string("<%s-msg%02d@%s>", F.lower(ticket), F.col(position).cast("int"), domain)
    note = F.col(kind) == "internal_note"
    before = Window.partitionBy(ticket).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    df = messages.withColumn("message_id", mid)
    prior = F.collect_list(F.when(~note, F.col("message_id"))).over(before)
    df = df.withColumn("reference_message_ids", F.when(note, F.array().cast("array<string>")).otherwise(prior))
    return df.withColumn("in_reply_to", F.try_element_at("reference_message_ids", F.lit(-1)))


def embedding_stats(vec) -> Column:
    """D7. struct<dimension, l2_norm, min, max, first_values>."""
    v = _col(vec)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.struct(F.size(v).alias("dimension"), norm.alias("l2_norm"), F.array_min(v).alias("min"), F.array_max(v).alias("max"), F.slice(v, 1, 20).alias("first_values"))


def l2_normalize(vec) -> Column:
    """The vector as doubles of length 1; null for a zero vector."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return bind(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))

    return bind(F.transform(_col(vec), lambda x: x.cast("double")), scaled)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def cosine(a, b) -> Column:
    """D8. Cosine similarity; null for a zero vector."""
    return dot(l2_normalize(a), l2_normalize(b))


def label_map(c, labels: dict[str, str] = CATEGORY_LABELS) -> Column:
    """D9. The label of a value; values without one stay."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(pairs[_col(c)], _col(c))


def sender_label(c) -> Column:
    return label_map(c, SENDER_LABELS)


def mask_connection(c) -> Column:
    """D9. The password of a connection string as ***."""
    return F.regexp_replace(_col(c), r"(://[^:/@]+):[^@]*@", "$1:***@")
