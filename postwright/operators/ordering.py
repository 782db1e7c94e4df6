"""Ranks, pages and quantiles of whole tables, by ranges and counts: no task sorts or holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Buckets of a round of narrowing, and rows that may be sorted in one place in the end.
BUCKETS, FEW = 512, 10_000


def _in_ranges(df: DataFrame, order: list[Column], scratch: Scratch, ranges: int | None) -> tuple[DataFrame, list]:
    """df written in ranges of the order with its range in or__range, and (range, rows) of each in order.

    Range numbers are kept with the rows, so a task that runs again finds the same. The counts, one for each range, come
    to the driver.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.write(df.repartitionByRange(ranges, *order).withColumn("or__range", F.spark_partition_id()))
    return placed, placed.groupBy("or__range").agg(F.count("*").alias("n")).orderBy("or__range").collect()


def global_rank(df: DataFrame, order: list[Column], to: str = "rank", ranges: int | None = None) -> DataFrame:
    """df with its place from 1 in a total order.

    Rows go to ranges of the order, each is ranked by itself and adds the rows of those before it. The order must tell all
    rows apart, else equal rows, which share a range, are placed as they come. The result's rows are written once.
    """
    scratch = Scratch(df.sparkSession)
    placed, counts = _in_ranges(df, order, scratch, ranges)
    before, starts = 0, []
    for r in counts:
        starts.append((r.or__range, before))
        before += r.n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "or__range int, or__start long"))
    own = F.row_number().over(Window.partitionBy("or__range").orderBy(*order))
    made = placed.join(offsets, "or__range").withColumn(to, (own + F.col("or__start")).cast("long")).drop("or__range", "or__start")
    return scratch.last(made)


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0, ranges: int | None = None, most_rows: int = FEW) -> DataFrame:
    """W11. Rows offset + 1 to offset + limit of a total order, in that order.

    Near the beginning (up to most_rows) the first rows are taken straight away. A deep page reads only the ranges of the
    order that it lies in, so what is sorted doesn't grow with the offset.
    """
    if offset + limit <= most_rows:
        return df.orderBy(*order).offset(offset).limit(limit)
    placed, counts = _in_ranges(df, order, Scratch(df.sparkSession), ranges)
    before, wanted, skip = 0, [], 0
    for r in counts:
        if before + r.n > offset and before < offset + limit:
            skip = skip if wanted else offset - before
            wanted.append(r.or__range)
        before += r.n
    return placed.filter(F.col("or__range").isin(wanted)).drop("or__range").orderBy(*order).offset(skip).limit(limit)


def quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, n, q0, q1, ...): exact quantiles of a numeric column in each group of keys; one row without keys.

    As the built-in percentile(): between the two rows around share * (n - 1) the value is interpolated. Each round counts the
    values in BUCKETS parts of the span in which a quantile's two rows lie, of all groups and shares at once, until at most
    FEW values are left in a span or all of them are equal; these are counted by value. Only counts are gathered, so a
    task holds no group's values. The spans (a row for each group and share) are broadcast: groups are few. Null values and
    NaN don't count, groups without a value aren't there.
    """
    keys = keys or []
    scratch = Scratch(df.sparkSession)
    names = [f"k{i}" for i in range(len(keys))]
    rows = scratch.write(df.select(*[F.col(k).alias(x) for k, x in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)])).alias("x")
    spans = rows.groupBy(*names).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).select(*names, "lo", "hi", "n", wanted)
    spans = spans.filter("n > 0").select(*names, "x.i", "n", (F.col("x.share") * (F.col("n") - 1)).alias("at"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    spans = scratch.write(spans.coalesce(1))
    same = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in names]
    by = [*names, "i"]
    for _ in range(200):
        if not spans.filter((F.col("inside") > FEW) & (F.col("lo") < F.col("hi"))).limit(1).count():
            break
        met = rows.alias("a").join(F.broadcast(spans.alias("b")), [*same, F.col("a.v").between(F.col("b.lo"), F.col("b.hi"))] if same else F.col("a.v").between(F.col("b.lo"), F.col("b.hi")))
        met = met.select(*[f"b.{x}" for x in by], "b.n", "b.at", "b.before", "v", F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / F.nullif(F.col("hi") / 2 - F.col("lo") / 2, F.lit(0.0)) * BUCKETS)).alias("bucket"))
        counts = met.groupBy(*by, "n", "at", "before", F.coalesce("bucket", F.lit(0)).alias("bucket")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("m").over(Window.partitionBy(*by).orderBy("bucket"))
        counts = counts.withColumn("ends", F.col("before") + upto)
        low, high = F.floor("at"), F.ceil("at")
        kept = counts.filter((F.col("ends") > low) & (F.col("ends") - F.col("m") <= high))
        spans = kept.groupBy(*by, "n", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.col("ends") - F.col("m")).alias("before"), F.sum("m").alias("inside"))
        spans = scratch.write(spans.coalesce(1))
    met = rows.alias("a").join(F.broadcast(spans.alias("b")), [*same, F.col("a.v").between(F.col("b.lo"), F.col("b.hi"))] if same else F.col("a.v").between(F.col("b.lo"), F.col("b.hi")))
    values = met.select(*[f"b.{x}" for x in by], "b.n", "b.at", "b.before", "v").groupBy(*by, "n", "at", "before", "v").agg(F.count("*").alias("m"))
    values = values.withColumn("ends", F.col("before") + F.sum("m").over(Window.partitionBy(*by).orderBy("v")))
    low, high = F.floor("at"), F.ceil("at")
    first = lambda place: F.min(F.when(F.col("ends") > place, F.col("v")))
    each = values.groupBy(*by, "n", "at").agg(first(low).alias("l"), first(high).alias("h"))
    each = each.withColumn("q", F.col("l") + (F.col("at") - F.floor("at")) * (F.col("h") - F.col("l")))
    made = each.groupBy(*names, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(shares))])
    return scratch.last(made.withColumnsRenamed(dict(zip(names, keys, strict=True))))
