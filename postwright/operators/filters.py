"""Filters, counts and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_email
from ..schemas import EMBEDDABLE, TERMINAL


def is_embeddable(c: str = "interaction_type") -> Column:
    return F.col(c).isin(EMBEDDABLE)


def embeddable(df: DataFrame) -> DataFrame:
    """P1."""
    return df.filter(is_embeddable())


def pending(df: DataFrame, model: str) -> DataFrame:
    """P2. Embeddable rows without a vector or with one of another model; a vector of no model isn't pending."""
    return embeddable(df).filter(F.col("embedding").isNull() | (F.col("embedding_model") != model))


def indexing_summary(df: DataFrame, model: str) -> DataFrame:
    """P3. scanned, already_current, embedded."""
    todo = F.coalesce(F.col("embedding").isNull() | (F.col("embedding_model") != model), F.lit(False))
    return embeddable(df).agg(F.count("*").alias("scanned"), F.count_if(~todo).alias("already_current"), F.count_if(todo).alias("embedded"))


def is_terminal(c: str = "status") -> Column:
    return F.col(c).isin(TERMINAL)


def open_tickets(df: DataFrame) -> DataFrame:
    """P4."""
    return df.filter(~is_terminal())


def select_queries(df: DataFrame, keys: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """P8. Those with a wanted key, or the first by key."""
    if keys is not None:
        df = df.join(keys.select("key").distinct(), "key", "left_semi")
    return df.orderBy("key").limit(limit) if limit else df


def unknown_keys(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """P8, U4. Wanted keys that don't exist."""
    return wanted.select("key").distinct().join(known.select("key"), "key", "left_anti")


def validate_customers(new: DataFrame, existing: DataFrame) -> DataFrame:
    """P9. new with name trimmed, inbox_email normalised, and problem: missing, exists, duplicate or null.

    Rows without an address take no part in the joins, however many they are; repeats are counted by address first.
    """
    df = new.withColumn("name", F.trim("name")).withColumn("inbox_email", normalize_email("inbox_email"))
    blank = F.coalesce("inbox_email", F.lit("")) == ""
    given = df.filter(~blank)
    have = existing.select(normalize_email("inbox_email").alias("inbox_email"), F.lit(True).alias("have")).distinct()
    repeated = given.groupBy("inbox_email").agg(F.count("*").alias("times")).filter("times > 1")
    given = given.join(have, "inbox_email", "left").join(repeated, "inbox_email", "left")
    problem = F.when(F.coalesce("name", F.lit("")) == "", "missing").when(F.col("have"), "exists").when(F.col("times") > 1, "duplicate")
    return given.select(*df.columns, problem.alias("problem")).unionByName(df.filter(blank).withColumn("problem", F.lit("missing")))


def matching(df: DataFrame, has_embedding: bool | None = None, **equal) -> DataFrame:
    """Optional equality filters; None leaves a column alone."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    if has_embedding is not None:
        df = df.filter(F.col("embedding").isNotNull() if has_embedding else F.col("embedding").isNull())
    return df
