"""Benchmark decontamination by template windows, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, small, table

UNITS = [
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "pounds", "oz", "ounces", "ml", "l",
    "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "year", "years",
    "percent", "degrees", "celsius", "fahrenheit", "kelvin", "dollars", "euros", "cents", "kmh", "mph", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "j", "kj", "v",
]
WINDOW = 5
#: A table of at most so many benchmark windows is broadcast; a larger one is joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: An item shorter than a window that more texts hold is everyday language, not a leak: a share of the distinct texts, at least a few.
COMMON_SHARE, COMMON_TEXTS = 0.001, 5
NAME = "⁣"  # an invisible separator put before names


def tokens_of(text: Column) -> Column:
    """Words and numbers in lower case; a capitalised word after a word and a blank, thus inside a sentence, starts
    with NAME."""
    named = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;:]\s)", NAME)
    return F.regexp_extract_all(F.lower(named), F.lit(NAME + r"?[\p{L}\p{N}]++(?:[.,'’_-][\p{L}\p{N}]++)*+"), F.lit(0))


def template_of(tokens: str) -> Column:
    """The tokens with numbers, names and units behind a number replaced by <num>, <name>, <unit>."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    digit = lambda x: f"ascii({x}) BETWEEN 48 AND 57"
    return F.expr(f"""transform({tokens}, (x, i) -> CASE WHEN {digit('x')} THEN '<num>' WHEN ascii(x) = {ord(NAME)} THEN '<name>'
        WHEN i > 0 AND {digit(f'get({tokens}, i - 1)')} AND array_contains(array({units}), x) THEN '<unit>' ELSE x END)""")


def windows_of(template: str, width: int, least_literal: int = 0) -> Column:
    """array<struct<h, at>> of the hashes of all windows; with least_literal, of those with as many plain words."""
    made = f"transform(sequence(1, size({template}) - {width - 1}), i -> named_struct('h', xxhash64({width}, slice({template}, i, {width})), 'at', i))"
    if least_literal:
        made = f"filter({made}, x -> size(filter(slice({template}, x.at, {width}), t -> NOT startswith(t, '<'))) >= {least_literal})"
    return F.expr(f"if(size({template}) >= {width}, {made}, array())")


def _raw(tokens: str) -> Column:
    """The tokens without the marks of names, which depend on the word before."""
    return F.expr(f"transform({tokens}, x -> replace(x, '{NAME}', ''))")


def _whole_items(texts: DataFrame, items: DataFrame, width: int, common_share: float, common_texts: int) -> DataFrame | None:
    """Rows of contaminated() for items without windows of their own, which are found as a whole or not at all.

    An item is looked up by its first `width` tokens (all, if fewer) and then compared to its end: the raw tokens, or,
    if it has three plain words, its template, in which a value must stand for one value. Items of fewer than `width` tokens must
    be rare: those in more distinct texts than common_share of all (and than common_texts) give no rows.
    None without such items.
    """
    short = cut(items.filter("size(bw) = 0 AND size(bp) > 0").select("item_id", "bp", "bt", _raw("bt").alias("br")))
    ways = short.withColumn("exact", F.explode(F.expr("if(size(filter(bp, t -> NOT startswith(t, '<'))) >= 3, array(true, false), array(true))")))
    ways = ways.withColumn("w", F.least(F.size("bp"), F.lit(width)))
    ways = ways.withColumn("h", F.expr("xxhash64(exact, w, slice(if(exact, br, bp), 1, w))"))
    kinds = sorted(tuple(r) for r in ways.select("exact", "w").distinct().collect())
    if not kinds:
        return None
    anchors = ways.select("item_id", "exact", "h")
    if anchors.count() <= BROADCAST_WINDOWS:
        anchors = F.broadcast(anchors)
    tokens = lambda df: df.select("k1", "k2", "doc_id", tokens_of(F.col("text")).alias("dt")).select("*", template_of("dt").alias("dp"), _raw("dt").alias("dr"))
    at = [f"if(size(dp) >= {w}, transform(sequence(1, size(dp) - {w - 1}), i -> named_struct('h', xxhash64({exact}, {w}, slice({'dr' if exact else 'dp'}, i, {w})), 'at', i)), array())" for exact, w in kinds]
    placed = tokens(texts).select("k1", "k2", F.explode(F.concat(*[F.expr(x) for x in at])).alias("x")).select("k1", "k2", F.col("x.h").alias("h"), F.col("x.at").alias("at"))
    likely = cut(placed.join(anchors, "h").groupBy("k1", "k2", "item_id").agg(F.collect_set(F.struct("exact", "at")).alias("places")))
    if any(w < width for _, w in kinds):
        # an item's documents are counted by text, so that copies of one text count once
        text = texts.select("k1", "k2", F.xxhash64("text").alias("kt"))
        most = max(common_texts, text.agg(F.countDistinct("kt")).first()[0] * common_share)
        brief = likely.join(short.filter(F.size("bp") < width).select("item_id"), "item_id", "left_semi").select("k1", "k2", "item_id")
        common = brief.join(text.distinct(), ["k1", "k2"]).groupBy("item_id").agg(F.countDistinct("kt").alias("n")).filter(F.col("n") > most)
        likely = cut(likely.join(small(cut(common.select("item_id")), BROADCAST_WINDOWS), "item_id", "left_anti"), [likely])
    sources = tokens(texts.join(likely.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    df = likely.join(sources, ["k1", "k2"]).join(short, "item_id")
    pairs = "array_distinct(filter(transform(bp, (t, j) -> named_struct('b', concat(t, bt[j]), 'd', concat(t, get(dt, p.at + j - 1)))), x -> startswith(x.b, '<')))"
    df = df.withColumn("copied", F.expr("exists(places, p -> p.exact AND slice(dr, p.at, size(br)) = br)"))
    df = df.withColumn("held", F.expr(f"exists(places, p -> NOT p.exact AND slice(dp, p.at, size(bp)) = bp AND size(array_distinct(transform({pairs}, x -> x.b))) = size({pairs}))"))
    df = df.filter("copied OR held").groupBy("k1", "k2", "doc_id", "item_id").agg(F.bool_and(~F.col("copied")).alias("changed"))
    return df.select("k1", "k2", "doc_id", "item_id", F.lit(1).cast("long").alias("windows"), F.lit(1.0).alias("share"), "changed")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, least_share: float = 0.5, least_run: int = 16,
                 common_share: float = COMMON_SHARE, common_texts: int = COMMON_TEXTS) -> DataFrame:
    """(k1, k2, doc_id, item_id, windows, share, changed): the documents that hold a benchmark item.

    Texts become templates, in which numbers, names and units are placeholders. Equal windows of `width` tokens
    meet by a hash join. Windows of one offset between document and item are one alignment; in it each value of
    the item's placeholders must stand for one value of the document, or else it doesn't count. share is the part
    of the item's windows found in such alignments; least_share of them makes a row, and so do least_run windows of
    one alignment, however long the item. changed: some value differs, so the question was given other parameters.
    Windows with fewer than three plain words don't count; items without any other, also those shorter than a
    window, are found as a whole (see _whole_items), with windows and share 1. Items shorter than a window, such as
    single words, count only if few texts hold them: at most common_texts, or common_share of the distinct texts. k1, k2 name the document's id and text: repeated rows give one row. Null
    ids of documents are kept; null and empty texts and items match nothing. Other columns aren't read.
    """
    items = benchmark.filter("text IS NOT NULL").select("item_id", tokens_of(F.col("text")).alias("bt")).distinct()
    every = cut(items.select("item_id", "bt", template_of("bt").alias("bp")).withColumn("bw", windows_of("bp", width, min(3, width))))
    items = every.filter("size(bw) > 0")
    windows = items.select("item_id", F.explode("bw").alias("w")).select("item_id", F.col("w.h").alias("h"), F.col("w.at").alias("b_at"))
    if windows.count() <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *row_key("doc_id", "text"))
    placed = texts.select("k1", "k2", tokens_of(F.col("text")).alias("t")).select("k1", "k2", template_of("t").alias("p"))
    placed = placed.select("k1", "k2", F.explode(windows_of("p", width)).alias("w")).select("k1", "k2", F.col("w.h").alias("h"), F.col("w.at").alias("d_at"))
    hits = placed.join(windows, "h").groupBy("k1", "k2", "item_id", (F.col("d_at") - F.col("b_at")).alias("shift")).agg(F.collect_set("b_at").alias("places"))
    sizes = items.select("item_id", F.size("bw").alias("n"))
    total = F.sum(F.size("places"))
    likely = hits.join(sizes, "item_id").groupBy("k1", "k2", "item_id").agg(total.alias("found"), F.first("n").alias("n"), F.collect_list(F.struct("shift", "places")).alias("shifts"))
    likely = cut(likely.filter((F.col("found") >= F.lit(least_share) * F.col("n")) | F.exists("shifts", lambda x: F.size(x.places) >= least_run)).drop("found"))
    keys = likely.select("k1", "k2").distinct()
    sources = texts.join(keys, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("k1", "k2", "doc_id", tokens_of(F.col("text")).alias("dt"))
    df = likely.join(sources, ["k1", "k2"]).join(items.select("item_id", "bt", "bp"), "item_id")
    df = df.select("k1", "k2", "doc_id", "item_id", "n", "bt", "bp", "dt", F.explode("shifts").alias("s")).select("*", "s.shift", "s.places").drop("s")
    # every placeholder of the windows found, with the item's and the document's value
    slots = F.expr(f"""array_distinct(transform(filter(array_distinct(flatten(transform(places, b -> sequence(b, b + {width - 1})))), j -> startswith(bp[j - 1], '<')),
        j -> named_struct('b', concat(bp[j - 1], bt[j - 1]), 'd', concat(bp[j - 1], dt[j + shift - 1]))))""")
    df = df.withColumn("slots", slots).withColumn("holds", F.expr("size(array_distinct(transform(slots, x -> x.b))) = size(slots)"))
    df = df.filter("holds").groupBy("k1", "k2", "doc_id", "item_id", "n").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("windows"), F.max(F.exists("slots", lambda x: x.b != x.d)).alias("changed"), F.max(F.size("places")).alias("run")
    )
    df = df.withColumn("share", F.col("windows") / F.col("n")).filter((F.col("share") >= least_share) | (F.col("run") >= least_run))
    df = df.select("k1", "k2", "doc_id", "item_id", "windows", "share", "changed")
    whole = _whole_items(texts, every, width, common_share, common_texts)
    return df if whole is None else df.unionByName(whole)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without any row in contaminated(); all columns, whatever their names."""
    bad = contaminated(docs, benchmark, **options).select(F.col("k1").alias("b1"), F.col("k2").alias("b2")).distinct()
    key = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("row", *row_key("doc_id", "text"))
    return key.join(bad, (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")), "left_anti").select("row.*")


def op3_benchmark_leaks(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2")
