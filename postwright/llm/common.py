"""Helpers that the training-data operators share: checkpoints, text spans, word counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.sources.scratch import delete_at_end, file_system

_ROOTS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; only a plain local session gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(shared)
    delete_at_end(spark, sc.getCheckpointDir())


def cut(df: DataFrame, used: Iterable[DataFrame] = ()) -> DataFrame:
    """Materialise and cut lineage: a table in the shared checkpoint folder, written once and read again.

    Parquet takes a fraction of the room of a checkpoint, and its sizes help later joins. used: earlier results of
    cut() that nothing reads after this; their files go. The other tables of an application go when the driver ends,
    also where its session was stopped before.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/tables"
    folder = f"{root}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    if root not in _ROOTS:
        _ROOTS.add(root)
        delete_at_end(spark, root)
    drop(*used)
    made = spark.read.schema(df.schema).parquet(folder)
    made.cut_folder = folder
    return made


def small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, else joined by shuffle. It is counted: cut() it before."""
    return F.broadcast(df) if df.count() <= most else df


def drop(*tables: DataFrame) -> None:
    """Delete the files of results of cut() that nothing reads any more."""
    for df in tables:
        fs, path = file_system(df.sparkSession, df.cut_folder)
        fs.delete(path, True)


def join_salted(left: DataFrame, right: DataFrame, on: list[str], n: str | None = None, counted: DataFrame | None = None, total: int | None = None, share: float = 1 / 500) -> DataFrame:
    """left joined with right, where no task gets all rows of one key.

    Keys with more than `share` of left's rows are split: left's rows go to parts by hash, and right's are copied to
    each part. There are fewer than 1 / share such keys, whose hashes alone come to the driver; without any, this is
    a plain join. n names a column of right with the number of left's rows of a key (right then has a row for each);
    else the rows of `counted` (None: left) are counted. What is counted is read twice: cut() it before, or rely on a
    reused exchange. total: about the number of left's rows, if known. Keys have one type on both sides.
    """
    counts = right.select(*on, F.col(n).alias("n")) if n else (counted or left).groupBy(*on).agg(F.count("*").alias("n"))
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(1.0, total * share)
    key = F.xxhash64(*on)
    hot = counts.filter(F.col("n") > most).orderBy(F.desc("n")).limit(int(2 / share)).select(key.alias("key"), "n").collect()
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    if not hot:
        return left.join(right, on).select(*columns)
    parts, split = -int(-max(r.n for r in hot) // most), key.isin([r.key for r in hot])
    left = left.withColumn("salt", F.when(split, F.pmod(F.xxhash64(*left.columns), F.lit(parts))).otherwise(0).cast("int"))
    right = right.withColumn("salt", F.explode(F.when(split, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "salt"]).select(*columns)


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes of the columns, never null: equal rows get equal keys, whatever their ids."""
    return [
        F.xxhash64(F.lit(1), *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols]).alias("k1"),
        F.xxhash64(F.lit(2), *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols]).alias("k2"),
    ]


def bound(value: str, name: str, body: str) -> str:
    """SQL for body with name standing for value, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def spans_sql(hits: str, gaps: str, chunk: int = 512) -> str:
    """SQL for array<struct<s,e,h,g>> of the hits of a pattern from its matches and the pieces between them.

    hits is regexp_extract_all(text, p, 0) and gaps split(text, p, -1): the i-th hit starts after i + 1 gaps and
    i hits. Offsets count code points, ends are exclusive; g is the whole gap before the hit. Sums run within
    chunks of hits, and over chunks, so that no array is copied for each hit.
    """
    parts = f"zip_with(slice({gaps}, 1, size({hits})), {hits}, (a, b) -> named_struct('a', char_length(a), 'n', char_length(b), 'h', b, 'g', a))"
    chunks = f"transform(sequence(0, (size(parts) - 1) div {chunk}), i -> slice(parts, i * {chunk} + 1, {chunk}))"
    starts = """aggregate(chunks, named_struct('p', 0, 'o', cast(array() as array<int>)),
        (acc, c) -> named_struct('p', acc.p + aggregate(c, 0, (t, x) -> t + x.a + x.n), 'o', array_append(acc.o, acc.p)), acc -> acc.o)"""
    spans = f"""flatten(zip_with(chunks, {starts}, (c, p) -> aggregate(c,
        named_struct('p', p, 'o', cast(array() as array<struct<s: int, e: int, h: string, g: string>>)),
        (acc, x) -> named_struct('p', acc.p + x.a + x.n, 'o', array_append(acc.o, named_struct('s', acc.p + x.a, 'e', acc.p + x.a + x.n, 'h', x.h, 'g', x.g))),
        acc -> acc.o)))"""
    none = "cast(array() as array<struct<s: int, e: int, h: string, g: string>>)"
    return f"if(size({hits}) > 0, {bound(parts, 'parts', bound(chunks, 'chunks', spans))}, {none})"


def find_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add for each name an array of the leftmost non-overlapping matches of its pattern, as spans_sql() has them."""
    df = df.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"{k}__h") for k, p in patterns.items()])
    none = F.array().cast("array<string>")
    df = df.select("*", *[F.when(F.size(f"{k}__h") > 0, F.split(text, p, -1)).otherwise(none).alias(f"{k}__g") for k, p in patterns.items()])
    kept = [c for c in df.columns if not c.endswith(("__h", "__g"))]
    return df.select(*kept, *[F.expr(spans_sql(f"{k}__h", f"{k}__g")).alias(k) for k in patterns])


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF and CR; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
