"""Documents made ready for training: five stages, each of which works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.llm.common import ensure_checkpoint_dir, table
from postwright.llm.decontaminate import drop_contaminated
from postwright.llm.linededup import dedup_lines
from postwright.llm.mixing import mix_sources, text_quality
from postwright.llm.neardup import keep_one_of_each
from postwright.llm.quality import keep_good, trusted_documents
from postwright.sources.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the language model rejects."""
    return keep_good(docs, trusted_documents(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of line runs; a document of which nothing is left goes, and n_chars follows the text."""
    made = dedup_lines(docs).filter("size(removed) = 0 OR text IS NULL OR trim(text) <> ''")
    length = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return made.withColumn("n_chars", length).drop("removed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken; taken / size is the number of copies."""
    return mix_sources(docs, text_quality()).filter("taken > 0")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]
#: Hashes, signatures and the language model aren't expressed in SQL; tests/llm hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again by the next.

    What a stage wrote goes once the next one has written; the last table stays, as it is the result.
    """
    ensure_checkpoint_dir(spark)
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(number)
    return docs
