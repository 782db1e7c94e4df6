"""Mixing sources to target shares by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_key, small, table, word_count

#: At most about so many documents of a source are sorted, near the key where its budget ends.
BUCKET_ROWS, PARTS = 10_000, 256
#: A table of at most so many sources, or of documents near the ends of budgets, is broadcast.
BROADCAST_SOURCES, BROADCAST_EDGE = 20_000, 500_000


def source_targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Add `target` to (source, source_size): shares of the total by weight, none above cap times its size.

    Sources in code point order, null last, get the weights in turn, repeating. What a capped source can't take
    is shared again by weight. That ends where target = min(cap * size, level * weight) for one level, so the
    sources are ordered by cap * size / weight and the level is read off the first that isn't capped. This works
    on the table of sources, one row each, never on documents.
    """
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    s = s.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("place", F.row_number().over(order))
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(Window.partitionBy(F.lit(0)))
    return s.withColumn("target", F.least("most", F.coalesce(free.getField("level"), F.lit(0.0)) * F.col("weight"))).drop("level", "ratio", "most", "place")


def _filled(edge: DataFrame, passes: int = 3) -> DataFrame:
    """edge (mix__s, mix__key, size, copies, k1, k2, room) with `extra`: 1 for the documents that fill the room.

    In order of key, documents join until the next would go over. Each further pass does the same with those left
    that still fit, so that one long document doesn't end a source far from its target.
    """
    df = edge.withColumn("extra", F.lit(0)).withColumn("whole", F.col("size") * F.col("copies"))
    source = Window.partitionBy("mix__s")
    order = source.orderBy("mix__key", "size", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(passes):
        fits = (F.col("extra") == 0) & (F.col("whole") <= F.col("room"))
        run = F.sum(F.when(fits, F.col("whole")).otherwise(0)).over(order)
        df = df.withColumn("joins", fits & (run <= F.col("room")))
        df = df.withColumn("room", F.col("room") - F.sum(F.when(F.col("joins"), F.col("whole")).otherwise(0)).over(source))
        df = df.withColumn("extra", F.when(F.col("joins"), 1).otherwise(F.col("extra"))).drop("joins")
    return df


def _narrowed(units: DataFrame, plan: DataFrame, bucket_rows: int) -> DataFrame:
    """(mix__t, low, high, room) for each source: documents with keys up to low are in, those above high out.

    Each round cuts the keys between low and high at PARTS quantiles, sums the sizes, and keeps the part where the
    budget ends, until no source has more than bucket_rows documents there.
    """
    bounds = plan.select(F.col("mix__s").alias("mix__t"), F.col("rest").alias("room"), F.lit(-1.0).alias("low"), F.lit(float("inf")).alias("high"), "rows")
    bounds = cut(bounds)
    most = bounds.agg(F.max("rows")).first()[0] or 0
    probabilities = [i / PARTS for i in range(1, PARTS)]
    while most > bucket_rows:
        inner = units.join(small(bounds, BROADCAST_SOURCES), F.col("mix__s").eqNullSafe(F.col("mix__t"))).filter("mix__key > low AND mix__key <= high")
        edges = cut(inner.groupBy("mix__t").agg(F.array_distinct(F.percentile_approx("mix__key", probabilities, 10_000)).alias("edges")).withColumnRenamed("mix__t", "mix__e"))
        inner = inner.join(small(edges, BROADCAST_SOURCES), F.col("mix__t").eqNullSafe(F.col("mix__e"))).withColumn("part", F.size(F.filter("edges", lambda x: x < F.col("mix__key"))))
        sums = inner.groupBy("mix__t", "part").agg(F.sum(F.col("size") * F.col("copies")).alias("held"), F.count("*").alias("rows"), F.first("edges").alias("edges"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("room").alias("room"))
        sums = sums.withColumn("upto", F.sum("held").over(Window.partitionBy("mix__t").orderBy("part")))
        after = sums.groupBy("mix__t").agg(F.min_by(F.struct("part", "edges", "low", "high", "room", "upto", "held", "rows"), F.when(F.col("upto") > F.col("room"), F.col("part"))).alias("x"), F.max("high").alias("all"))
        low, high = F.coalesce(F.get("x.edges", F.col("x.part") - 1), "x.low"), F.coalesce(F.get("x.edges", F.col("x.part")), "x.high")
        ends = F.col("x").isNull()  # the room holds all
        after = after.select("mix__t", F.when(ends, 0.0).otherwise(F.col("x.room") - F.col("x.upto") + F.col("x.held")).alias("room"), F.when(ends, F.col("all")).otherwise(low).alias("low"), F.when(ends, F.col("all")).otherwise(high).alias("high"), F.when(ends, 0).otherwise(F.col("x.rows")).alias("rows"))
        bounds, before = cut(after), most
        most = bounds.agg(F.max("rows")).first()[0] or 0
        if most >= before:
            break
    return bounds


def mix_sources(docs: DataFrame, quality: Column | None = None, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 17, with_text: bool = True, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each row of docs: its columns, size (words), source_size, target, taken.

    A source's target holds floor(target / source_size) complete epochs of all its documents; the rest is drawn
    without replacement: each document gets the exponential key -ln(u) / quality, u from a hash of its id, text
    and the seed, and documents join in order of key while their summed size is within the rest; where a document
    is too long for what is left, later ones that fit fill it. taken = size times the number of copies taken, so
    no document exceeds ceil(cap) times its size. quality: a positive weight per row (null or not positive: 1e-6),
    default 1.

    Null and empty texts have size 0; a null source is a source of its own; null ids stay. Rows that are equal in
    id, text and source are one document with copies, which are taken or left together. Equal keys are ordered by
    size and row hash, so runs agree whatever the partitioning. An empty table gives an empty result. Columns of
    docs with the names of results are replaced, others may have any name. A source is never sorted whole: only
    the documents near the key where its budget ends are. with_text=False leaves the text out; then texts are read
    once.
    """
    names = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in names and (with_text or c != "text")]
    quality = F.lit(1.0) if quality is None else quality
    weight = F.when(quality > 0, quality).otherwise(F.lit(1e-6))
    row = F.struct(*[F.col(c) for c in kept]).alias("mix__row")
    df = docs.select(row, F.col("source").alias("mix__s"), word_count(F.col("text")).alias("size"), weight.alias("mix__w"), *row_key("doc_id", "text", "source"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "k1", "k2")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    df = df.withColumn("mix__key", -F.log(u) / F.col("mix__w"))
    if not with_text:
        df = cut(df)
    units = cut(df.groupBy("mix__s", "k1", "k2", "size", "mix__key").agg(F.count("*").alias("copies")))
    sources = units.groupBy(F.col("mix__s").alias("source")).agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("rows"))
    plan = source_targets(sources, cap, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    plan = plan.select(F.col("source").alias("mix__s"), "source_size", "target", "rows", epochs.alias("epochs"))
    plan = cut(plan.withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))))
    bounds = _narrowed(units, plan, bucket_rows)
    edge = units.join(small(bounds, BROADCAST_SOURCES), F.col("mix__s").eqNullSafe(F.col("mix__t"))).filter("mix__key > low AND mix__key <= high")
    taken = cut(_filled(edge).filter("extra = 1").select(F.col("k1").alias("t1"), F.col("k2").alias("t2")))
    plan = plan.join(bounds, F.col("mix__s").eqNullSafe(F.col("mix__t"))).select(F.col("mix__s").alias("mix__t"), "source_size", "target", "epochs", "low", "high")
    df = df.join(small(plan, BROADCAST_SOURCES), F.col("mix__s").eqNullSafe(F.col("mix__t")))
    df = df.join(small(taken, BROADCAST_EDGE), (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")), "left")
    extra = F.when((F.col("mix__key") <= F.col("low")) | F.col("t1").isNotNull(), 1).otherwise(0)
    return df.select("mix__row.*", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + extra)).cast("long").alias("taken"))


def text_quality(text: str = "text", usual: float = 6.0) -> Column:
    """Between 0 and 1: usual / (characters per word) or its inverse; 0.05 at least, and for null and empty texts."""
    ratio = F.length(text) / (F.greatest(word_count(F.col(text)), F.lit(1)) * usual)
    return F.coalesce(F.greatest(F.least(ratio, 1 / F.nullif(ratio, F.lit(0.0))), F.lit(0.05)), F.lit(0.05))


def op5_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, text_quality(), with_text=False).select("doc_id", "source", "size", "source_size", "target", "taken")
