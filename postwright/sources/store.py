"""A keyed table in hash buckets: an upsert rewrites only the buckets that its keys fall into."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table. A bucket is what an upsert rewrites at least, so it should hold some hundred megabytes.
BUCKETS = 64


def newest(rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row of each key: the last by `order` (nulls first), of equals the one with the greater hash.

    Rows meet by partial maxima, so a key that holds most of the rows is no burden on one task.
    """
    names = [c for c in rows.columns if c != key]
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind]
    age = F.struct(*(order or []), F.xxhash64(*hashed).alias("st__hash"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), age).alias("st__x")).select(key, "st__x.*").select(rows.columns)


class BucketStore:
    """A table at `path`, one row a key, changed by upsert() and read by read().

    Files of a bucket lie in one folder data/<commit>/bucket=<n>. commits/<version> is a small JSON file that names
    the folder of each bucket, the schema, and the last batch of each writer; the greatest version counts. Rows are
    written first and the commit last, under a name that must be new: a job that dies in between changes nothing for
    readers, one that runs again finds its batch committed and does nothing, and of two writers at a time one fails. This
    needs a file system that creates a file exclusively (HDFS, local, or an object store with conditional writes).

    A bucket never has more than one live folder, so reads don't slow down with the number of upserts. `keep` commits
    remain readable, and vacuum() deletes the folders that none of them names; upsert() calls it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = BUCKETS, keep: int = 2):
        self.spark, self.path, self.key, self.keep = spark, path, key, keep
        jvm = spark.sparkContext._jvm
        self._file = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._file("data").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        last = self.commit()
        self.buckets = last["buckets"] if last else buckets

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._file(folder)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._file(folder))]

    def versions(self) -> list[int]:
        return sorted(int(x) for x in self._names("commits") if x.isdigit())

    def commit(self, version: int | None = None) -> dict | None:
        """The commit of a version (None: the last one); None in a new table."""
        known = self.versions()
        if not known:
            return None
        name = f"commits/{known[-1] if version is None else version:010d}"
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _load(self, commit: dict, only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in sorted(commit["folders"].items()) if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], commit["schema"])
        return self.spark.read.schema(commit["schema"]).parquet(*folders)

    def read(self, keys: list | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version (None: the last); with keys, only the buckets of these are read."""
        commit = self.commit(version)
        if commit is None:
            raise ValueError(f"nothing was written to {self.path} yet")
        if keys is None:
            return self._load(commit)
        kind = dict(self._load(commit).dtypes)[self.key]
        asked = self.spark.createDataFrame([(k,) for k in keys], f"`{self.key}` {kind}")
        only = {r[0] for r in asked.select(self.bucket_of()).distinct().collect()}
        return self._load(commit, only).join(F.broadcast(asked.distinct()), self.key, "left_semi")

    def upsert(self, updates: DataFrame, order: list[str] | None = None, writer: str | None = None, batch: int = 0) -> int:
        """Put the rows of updates in place of those with the same key; gives the version that holds them.

        Of several updates with one key newest() decides; updates win over stored rows. Rows with a null key are one
        row. A writer's batch that is committed already changes nothing. Only buckets that updates fall into are read and
        rewritten. New columns of updates are added (null in old rows); missing ones become null.
        """
        last = self.commit()
        version = self.versions()[-1] if last else 0
        if last and writer is not None and last["writers"].get(writer, -1) >= batch:
            return version
        new = newest(updates, self.key, order)
        touched = sorted(r[0] for r in new.select(self.bucket_of()).distinct().collect())
        folder = f"data/{version + 1:010d}-{uuid.uuid4().hex}"
        folders = dict(last["folders"]) if last else {}
        schema = _ddl(new)
        if touched:
            if last:
                old = self._load(last, set(touched))
                known = new.select(F.col(self.key).alias("st__key"))
                new = old.join(known, F.col(self.key).eqNullSafe(F.col("st__key")), "left_anti").unionByName(new, allowMissingColumns=True)
                schema = _ddl(new)
            # one task writes a bucket: it is as large as the table divided by the number of buckets
            rows = new.withColumn("st__bucket", self.bucket_of()).repartition(len(touched), "st__bucket")
            rows.withColumnRenamed("st__bucket", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            folders |= {str(b): f"{folder}/bucket={b}" for b in touched}
        elif last:
            schema = last["schema"]
        writers = dict(last["writers"]) if last else {}
        if writer is not None:
            writers[writer] = batch
        self._publish(version + 1, {"buckets": self.buckets, "schema": schema, "folders": folders, "writers": writers})
        self.vacuum()
        return version + 1

    def _publish(self, version: int, commit: dict) -> None:
        """Write a commit under its final name by one rename of a finished file, which fails if the name is taken."""
        draft, final = self._file(f"commits/_{uuid.uuid4().hex}"), self._file(f"commits/{version:010d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another job")

    def vacuum(self) -> None:
        """Delete commits but for the last `keep`, and every data folder that none of those names, orphans included."""
        known = self.versions()
        live: dict[str, set[str]] = {}
        for v in known[-self.keep :]:
            for f in self.commit(v)["folders"].values():
                live.setdefault(f.split("/")[1], set()).add(f.split("/")[2])
        for v in known[: -self.keep]:
            self._fs.delete(self._file(f"commits/{v:010d}"), False)
        for name in self._names("data"):
            if name not in live:
                self._fs.delete(self._file(f"data/{name}"), True)
                continue
            for part in self._names(f"data/{name}"):
                if part.startswith("bucket=") and part not in live[name]:
                    self._fs.delete(self._file(f"data/{name}/{part}"), True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
