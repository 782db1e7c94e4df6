"""Intermediate tables in the shared checkpoint folder, and their end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder, and its path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """Delete a folder that exists when the driver's JVM ends, whether or not the session was stopped before."""
    fs, path = file_system(spark, folder)
    fs.deleteOnExit(path)


class Scratch:
    """Tables that are written once and read many times; drop() deletes those that nothing reads any more.

    They lie in the folder of spark.checkpoint.dir, which executors share, so that a lost executor loses nothing, and
    what is read from them has a short plan. Only a plain local session without that setting gets a folder of its own.
    What is left, such as the last table, goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []
        sc = spark.sparkContext
        root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
            root = sc.getCheckpointDir()
            delete_at_end(spark, root)  # Spark's own folder in it
        self.root = f"{root}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        folder = f"{self.root}/{len(self.folders)}"
        df.write.option("compression", "zstd").parquet(folder)
        if not self.folders:
            delete_at_end(self.spark, self.root)
        self.folders.append(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, upto: int | None = None) -> None:
        """Delete the tables written before number `upto` (None: all)."""
        n = len(self.folders) if upto is None else upto
        for folder in [f for f in self.folders[:n] if f]:
            fs, path = file_system(self.spark, folder)
            fs.delete(path, True)
        self.folders[:n] = [""] * n

    def last(self, df: DataFrame) -> DataFrame:
        """df as the result: written, and all tables before it deleted. Its own files stay, as it is read later."""
        made = self.write(df)
        self.drop(len(self.folders) - 1)
        return made
