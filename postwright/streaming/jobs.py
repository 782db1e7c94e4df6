"""Incremental indexing and mail routing in micro-batches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.filters import pending
from ..operators.ranking import hashed_embedding
from ..operators.routing import route
from ..sources.store import BUCKETS, BucketStore


def index_rows(rows: DataFrame, model: str, embed: Callable = hashed_embedding, clean: Callable = clean_text) -> DataFrame:
    """The pending rows, cleaned and with a vector of the model."""
    df = pending(rows, model).withColumn("clean_content", clean("raw_content"))
    return df.withColumn("embedding", embed(F.col("clean_content"))).withColumn("embedding_model", F.lit(model))


def incremental_index(source: DataFrame, target: str, checkpoint: str, model: str, embed: Callable = hashed_embedding, buckets: int = BUCKETS):
    """X1. Index a stream of new or changed interactions into target, then stop.

    target is a BucketStore: each micro-batch rewrites the buckets of its ids, and one that is run again after its
    commit changes nothing. Batches are known by the query's id, which its checkpoint keeps, so a stream that
    starts anew with another checkpoint isn't taken for a repeat. Of several rows of one id in a micro-batch the one
    created last counts, then the one with the greater hash.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        query = json.loads(session.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        order = [c for c in ("created_at",) if c in batch.columns]
        BucketStore(session, target, buckets=buckets).upsert(index_rows(batch, model, embed), order, query, batch_id)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of each id that incremental_index() wrote."""
    return BucketStore(spark, target).read()


def route_mail(source: DataFrame, tables: Callable[[SparkSession], dict[str, DataFrame]], target: str, checkpoint: str):
    """X2. Route a stream of emails against stored tables, which each micro-batch reads anew; then stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        t = tables(batch.sparkSession)
        route(batch, t["customers"], t["interactions"], t["tickets"]).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
